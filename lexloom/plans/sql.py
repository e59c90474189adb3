"""SQL for the same results, built from the same fixed values."""

from __future__ import annotations

from lexloom.functions import scoring as S
from lexloom.functions import text as T
from lexloom.functions import weights as w
from lexloom.operators.features import category_names

BIG = 6


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{T.TAG}', '', 'g')"


def space(x: str) -> str:
    x = rf"regexp_replace({x}, '^[{T.WHITE}]+|[{T.WHITE}]+\z', '', 'g')"
    x = rf"regexp_replace({x}, '[{T.WHITE}]*\n[{T.WHITE}]*\n[{T.WHITE}]*', chr(64976), 'g')"
    x = rf"regexp_replace({x}, '[{T.HORIZONTAL}]*\n[{T.HORIZONTAL}]*', ' ', 'g')"
    return f"replace({x}, chr(64976), chr(10) || chr(10))"


def tokens(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}'']+'), lambda t: lower(t))"


def lexicon(rows) -> str:
    values = ", ".join(f"({quoted(c)}, {quoted(word)}, {n})" for c, word, n in rows)
    return f"lex(category, word, mult) AS (VALUES {values})"


def cleaned(source: str) -> str:
    """CTEs src(k, text) -> clean(k, c, toks); ``source`` selects k and text."""
    return f"src AS ({source}), clean AS (SELECT k, c, {tokens('c')} AS toks FROM (SELECT k, {space(strip("coalesce(text, '')"))} AS c FROM src))"


def features(rows, source: str, groups: str = "") -> str:
    """CTEs up to feat(k, n, coverage, avg_word_length, big_word_ratio, pct_...).

    ``groups``: what makes grp(keys, k) of the counts of each k, whose sums are taken instead.
    """
    names = category_names(rows)
    m = ", ".join(f"sum(CASE WHEN category = {quoted(c)} THEN mult ELSE 0 END) AS m_{c}" for c in names)
    cnt = ", ".join(f"coalesce(sum(m_{c}), 0)::BIGINT AS cnt_{c}" for c in names)
    pct = ", ".join(f"CASE WHEN n > 0 THEN cnt_{c}::DOUBLE / n * 100 ELSE 0::DOUBLE END AS pct_{c}" for c in names)
    return f"""WITH {lexicon(rows)}, {cleaned(source)},
wide AS (SELECT word, {m} FROM lex GROUP BY word),
tok AS (SELECT k, unnest(toks) AS t FROM clean),
cnt AS (SELECT clean0.k, count(t)::BIGINT AS n, count(wide.word)::BIGINT AS covered, coalesce(sum(strlen(t)), 0)::BIGINT AS bytes,
  count(*) FILTER (WHERE strlen(t) >= {BIG})::BIGINT AS big, {cnt}
  FROM (SELECT DISTINCT k FROM clean) clean0 LEFT JOIN tok ON tok.k IS NOT DISTINCT FROM clean0.k LEFT JOIN wide ON wide.word = t GROUP BY clean0.k),
{groups}feat AS (SELECT {'*, ' if groups else ''}k, n, covered, CASE WHEN n > 0 THEN covered::DOUBLE / n ELSE 0::DOUBLE END AS coverage,
  CASE WHEN n > 0 THEN bytes::DOUBLE / n ELSE 0::DOUBLE END AS avg_word_length,
  CASE WHEN n > 0 THEN big::DOUBLE / n ELSE 0::DOUBLE END AS big_word_ratio, {pct} FROM {'grp' if groups else 'cnt'})"""


def number(x: float) -> str:
    return f"{x!r}::DOUBLE"


def round2(x: str) -> str:
    return f"(round(({x}) * 100) / 100)"


def trait(name: str) -> str:
    x = number(w.START) + "".join(f" + {number(v)} * pct_{c}" for c, v in w.TRAITS[name])
    return f"(CASE WHEN {x} < 0 THEN 0::DOUBLE WHEN {x} > 1 THEN 1::DOUBLE ELSE {round2(x)} END)"


def summary(name: str) -> str:
    plus, minus, divisor = w.SUMMARY[name]
    x = " + ".join(f"pct_{c}" for c in plus) + "".join(f" - pct_{c}" for c in minus)
    return round2(f"1::DOUBLE / (1::DOUBLE + exp(-(({x}) / {number(float(divisor))})))")


FLAG = "CASE WHEN n < 500 THEN 'low' WHEN coverage < 0.6::DOUBLE THEN 'medium' WHEN n < 1000 THEN 'medium' ELSE 'high' END"
WIDTH = round2(
    "least(greatest(coalesce(1.96::DOUBLE * (0.08::DOUBLE / sqrt(nullif(n::DOUBLE, 0) / 1000::DOUBLE)) * "
    "CASE WHEN coverage < 0.5::DOUBLE THEN 1.5::DOUBLE WHEN coverage < 0.7::DOUBLE THEN 1.2::DOUBLE ELSE 1::DOUBLE END, 0.25::DOUBLE), 0.02::DOUBLE), 0.25::DOUBLE)"
)
BOUNDS = "[" + ", ".join(number(p) for p in S.PERCENTILES) + "]"


def percentile(x: str) -> str:
    return f"(1 + len(list_filter({BOUNDS}, lambda p: p <= {x})))::INTEGER"


def trait_label(name: str, x: str) -> str:
    high, low, middle, closed = w.TRAIT_LABELS[name]
    return f"CASE WHEN {x} {'>=' if closed else '>'} {number(w.HIGH)} THEN '{high}' WHEN {x} < {number(w.LOW)} THEN '{low}' ELSE '{middle}' END"


def summary_label(name: str, x: str) -> str:
    _, high, low, middle = w.SUMMARY_LABELS[name]
    return f"CASE WHEN {x} >= {number(w.HIGH)} THEN '{high}' WHEN {x} < {number(w.LOW)} THEN '{low}' ELSE '{middle}' END"


def summed(rows) -> str:
    """The sums of all counts, for grp."""
    return ", ".join([*(f"sum({c})::BIGINT AS {c}" for c in ("n", "covered", "bytes", "big")), *(f"sum(cnt_{c})::BIGINT AS cnt_{c}" for c in category_names(rows))])


def scored(rows, source: str, groups: str = "") -> str:
    """CTEs up to sc: feat with all traits, summary variables, flag and w."""
    own = ", ".join([f"{trait(t)} AS {t}" for t in w.TRAITS] + [f"{summary(s)} AS {s}" for s in w.SUMMARY])
    return f"{features(rows, source, groups)}, sc AS (SELECT *, {own}, {FLAG} AS flag, {WIDTH} AS w FROM feat)"


def narrative(footer: str) -> str:
    two = lambda x: f"printf('%.2f', {x})"
    lo, hi = (lambda x: round2(f"greatest(0::DOUBLE, {x} - w)")), (lambda x: round2(f"least(1::DOUBLE, {x} + w)"))
    line = lambda t: f"'**{w.TRAIT_NAMES[t]}:** ' || {two(t)} || ' (' || {trait_label(t, t)} || ') — ' || {percentile(t)}::VARCHAR || 'th percentile (95% CI: ' || {two(lo(t))} || '–' || {two(hi(t))} || ')' || chr(10) || chr(10)"
    nl = "chr(10) || chr(10)"
    parts = [f"'## Psychological Profile' || {nl} || '**Confidence level:** ' || flag || {nl} || '### Big Five (OCEAN)' || {nl}"]
    parts += [line(t) for t in w.BIG_FIVE_TRAITS]
    parts += [f"'### {w.TRAIT_NAMES[t]}' || {nl} || {line(t)}" for t in w.TRAITS if t not in w.BIG_FIVE_TRAITS]
    values = ", ".join(f"{{'m': -pct_{v}, 'k': '{v}', 't': '- **{d}:** ' || {two(f'pct_{v}')} || '% of words'}}" for v, d in w.VALUES.items())
    parts.append(f"'### Schwartz Value Orientation' || {nl} || array_to_string(list_transform(list_sort([{values}]), lambda r: r.t), chr(10)) || {nl}")
    parts.append(f"'### Summary Variables' || {nl}")
    parts += [f"'- **{w.SUMMARY_LABELS[s][0]}:** ' || {two(s)} || ' — ' || {summary_label(s, s)} || chr(10)" for s in w.SUMMARY_LABELS]
    parts.append(f"chr(10) || '---' || chr(10) || '*{footer}*'")
    return " || ".join(f"({p})" for p in parts)
