"""Quality rules as learned decision lists over statistics of texts.

Statistics are counts of a text and whole numbers made of them (shares in percent, means in tenths),
each with a bound, all by built-in functions on the text's own row: no word leaves it. Sequential
covering learns an ordered list of rules from labelled documents. A rule grows by the threshold that
gains most information (FOIL) about the documents which it covers of two thirds of them, and is cut back
to the conditions that are worth it on the other third; what it covers is taken away, and the next
one grows. The list is one Spark expression, a chain of WHEN, that gives the number of the first rule
that holds, or none. The data of each step is a histogram, a row for each statistic and value at most, summed by Spark.

Bounded sample: SAMPLE labelled documents at most, those whose ids hash lowest; statistics and verdicts are
of all documents. Repeated windows are found by 64-bit hashes of their words.

Cases: a null text has no words; label rows with a null id or quality, or a quality other than 0 and 1,
are ignored, of a document labelled twice the lower holds; of rows that share a labelled id the fit sees one; labels
of one kind, or none, give an empty list, which keeps all; documents without an id are judged like any
other; repeated rows each get a result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import lowest_hashes, staged, table

#: Labelled documents at most; rules of a list, conditions of a rule.
SAMPLE, RULES, CONDITIONS = 20_000, 12, 4
#: The least share of rejected documents among those that a rule covers, and how many of these there must be.
PRECISION, SUPPORT = 0.8, 3
#: Of SPLIT documents one is for pruning.
SPLIT, SEED = 3, 5
#: Base rules: fewer words, or more of them (percent) in repeated windows of three, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
SPACE = r"[\x20\x09-\x0D]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# --- statistics ----------------------------------------------------------------------------


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many of ``words`` are in windows of three that occur twice or more."""
    hashed = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def places(rows: Column) -> Column:
        """The windows whose hash a neighbour has, by place."""
        at = lambda j: F.get(rows, j)["h"]
        return F.sort_array(F.transform(F.filter(rows, lambda x, j: (x["h"] == at(j - 1)) | (x["h"] == at(j + 1))), lambda x: x["i"]))

    def covered(found: Column) -> Column:
        """Each window covers three words, less those that the next one covers too."""
        return F.aggregate(F.transform(found, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(found, j + 1), x + 3) - x)), F.lit(0).cast("long"), lambda a, x: a + x)

    return bound(F.sort_array(hashed), lambda rows: bound(places(rows), covered))


def counts(text: Column) -> Column:
    """A struct of the counts of ``text``, each pass over its words, lines or characters made once."""
    count = lambda t, pattern: F.regexp_count(t, F.lit(pattern)).cast("long")

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE + "+"), lambda x: x != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        own = lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(F.filter(w, lambda x: F.char_length(x) <= 3)).cast("long").alias("n_short"),
        )
        rest = lambda li: F.struct(F.size(li).cast("long").alias("n_lines"), (F.size(li) - F.size(F.array_distinct(li))).cast("long").alias("n_dup_lines"))
        return F.struct(
            bound(words, own).alias("w"), bound(lines, rest).alias("l"),
            (F.char_length(t) - count(t, SPACE)).cast("long").alias("word_chars"), count(t, r"[#*$%&|<>]").alias("n_symbols"),
            count(t, "!").alias("n_exclaims"), count(t, r"\p{Lu}").alias("n_upper"), count(t, "[0-9]").alias("n_digits"),
        )

    return bound(F.coalesce(text, F.lit("")), of)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of BASE, and those that statistics need besides."""
    rows = docs.withColumn("__c", counts(F.col(text)))
    names = {"n_words": "w", "n_repeat_words": "w", "n_distinct": "w", "n_short": "w", "n_lines": "l", "n_dup_lines": "l"}
    rest = ("word_chars", "n_symbols", "n_exclaims", "n_upper", "n_digits")
    return rows.withColumns({n: F.col(f"__c.{s}.{n}") for n, s in names.items()} | {n: F.col(f"__c.{n}") for n in rest}).drop("__c")


def _share(part: str, whole: str, times: int, most: int) -> Column:
    """``times`` the share, as a whole number from 0 to ``most``; 0 of nothing."""
    return F.when(F.col(whole) > 0, F.least(F.floor(F.col(part) * times / F.col(whole)), F.lit(most))).otherwise(F.lit(0)).cast("int")


def statistics() -> dict[str, Column]:
    """What rules are made of, by name: whole numbers from 0 to a bound, over the columns of :func:`counted`."""
    return {
        "words": F.least(F.col("n_words"), F.lit(2000)).cast("int"),
        "mean_word_tenths": _share("word_chars", "n_words", 10, 500),
        "symbols_per_100_words": _share("n_symbols", "n_words", 100, 500),
        "exclaims_per_100_words": _share("n_exclaims", "n_words", 100, 500),
        "dup_line_percent": _share("n_dup_lines", "n_lines", 100, 100),
        "repeat_word_percent": _share("n_repeat_words", "n_words", 100, 100),
        "distinct_word_percent": _share("n_distinct", "n_words", 100, 100),
        "short_word_percent": _share("n_short", "n_words", 100, 100),
        "upper_percent": _share("n_upper", "word_chars", 100, 100),
        "digit_percent": _share("n_digits", "word_chars", 100, 100),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


# --- rules ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    """A statistic is at least, or at most, a value."""

    name: str
    at_least: bool
    value: int

    def column(self) -> Column:
        return F.col(self.name) >= self.value if self.at_least else F.col(self.name) <= self.value

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<='} {self.value}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = rule[0].column()
    for c in rule[1:]:
        out = out & c.column()
    return out


def first_rule(rules: list[Rule]) -> Column:
    """The number of the first of ``rules`` that holds, from 1, or null: one conditional expression over the statistics."""
    out = F
    for number, rule in enumerate(rules, 1):
        out = out.when(holds(rule), F.lit(number))
    return F.lit(None).cast("int") if out is F else out


# --- learning ------------------------------------------------------------------------------


def histograms(rows: DataFrame) -> dict[str, list[tuple[int, int, int]]]:
    """By statistic, (value, rejected, kept) of ``rows``, by rising value."""
    names = list(statistics())
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(n).alias("v")) for i, n in enumerate(names)]))
    counts = rows.select("rejected", each.alias("e")).groupBy("e.s", "e.v").agg(F.sum("rejected").alias("p"), F.sum(1 - F.col("rejected")).alias("n")).collect()
    out: dict[str, list[tuple[int, int, int]]] = {n: [] for n in names}
    for r in sorted(counts, key=lambda r: (r["s"], r["v"])):
        out[names[r["s"]]].append((r["v"], r["p"], r["n"]))
    return out


def gain(p: int, n: int, all_p: int, all_n: int) -> float:
    """FOIL's: bits about the rejected documents that stay covered."""
    return p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n))) if p else 0.0


def best(found: dict[str, list[tuple[int, int, int]]]) -> tuple[float, Condition | None, int, int]:
    """The condition that gains most, and what it covers; thresholds are half-way between values that occur. Ties go to the first statistic, to ``at least`` and to the smaller value."""
    out: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for name, rows in found.items():
        values = [v for v, _, _ in rows]
        below = list(accumulate(((p, n) for _, p, n in rows), lambda a, b: (a[0] + b[0], a[1] + b[1]), initial=(0, 0)))
        all_p, all_n = below[-1]
        for at_least in (True, False):
            for k in range(1, len(values)):  # between values k - 1 and k
                p, n = (all_p - below[k][0], all_n - below[k][1]) if at_least else below[k]
                if (own := gain(p, n, all_p, all_n)) > out[0]:
                    middle = values[k - 1] + values[k]
                    out = own, Condition(name, at_least, -(-middle // 2) if at_least else middle // 2), p, n
    return out


def grown(rows: DataFrame) -> Rule:
    """A rule for ``rows``: the best condition again and again, until it covers no kept document."""
    rule: Rule = ()
    while len(rule) < CONDITIONS:
        _, condition, p, n = best(histograms(rows))
        if condition is None or p < SUPPORT:
            break
        rule, rows = (*rule, condition), rows.where(condition.column())
        if not n:
            break
    return rule


def pruned(rule: Rule, rows: DataFrame) -> tuple[Rule, int, int]:
    """The first conditions of ``rule`` that do best on the documents for pruning, and the rejected and kept documents of all ``rows`` that they cover."""
    starts = [rule[: k + 1] for k in range(len(rule))]
    count = lambda r, y, some: F.count(F.when(holds(r) & (F.col("rejected") == y) & some, 1))
    sums = rows.agg(*[count(r, y, some) for r in starts for some in (F.col("pruning"), F.lit(True)) for y in (1, 0)]).first()
    worth = lambda p, n: (p - n) / (p + n) if p + n else -1.0
    at = max(range(len(starts)), key=lambda k: (worth(*sums[4 * k : 4 * k + 2]), worth(*sums[4 * k + 2 : 4 * k + 4]), -k))
    return starts[at], sums[4 * at + 2], sums[4 * at + 3]


def learn(rows: DataFrame) -> list[Rule]:
    """The list for the staged table ``rows`` (rejected 0 or 1, pruning boolean, and the statistics)."""
    rules: list[Rule] = []
    while len(rules) < RULES:
        left = rows.where(first_rule(rules).isNull())
        if not (rule := grown(left.where("NOT pruning"))):
            break
        rule, p, n = pruned(rule, left)
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(rule)
    return rules


def labelled(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Of labelled documents that pass the base rules, the statistics: a sample of ``bound`` documents at most."""
    quality = F.col("quality").try_cast("int")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), quality.alias("__quality")).where("doc_id IS NOT NULL AND __quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("__quality").alias("__quality"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = staged(known.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    sample = staged(lowest_hashes(known, bound, known.count(), SEED), "sample")
    rows = counted(own.join(F.broadcast(sample), "doc_id"))  # SAMPLE ids at most
    pruning = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(SPLIT)) == 0
    rows = rows.select("doc_id", (1 - F.col("__quality")).alias("rejected"), pruning.alias("pruning"), *[c.alias(n) for n, c in statistics().items()], base_failed().alias("failed"))
    least = F.min(F.struct("failed", "rejected", "pruning", *statistics())).alias("r")  # of rows that share an id one that passes, if any does
    # The filter comes last: Spark would move an earlier one below the join, to all documents.
    return staged(rows.groupBy("doc_id").agg(least).select("r.*").where("NOT failed").drop("failed"), "statistics")


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, the counts of BASE, base_failed, rule, kept) of all rows of ``docs`` (doc_id, text); ``rule`` is the number of the one that rejects."""
    rows = counted(docs.select("doc_id", "text")).withColumns(statistics()).withColumns({"base_failed": base_failed(), "rule": first_rule(rules)})
    return rows.select("doc_id", *BASE, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def op11_rule_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document, by a list learned from all labels."""
    docs = table(spark, sf_dir, "documents")
    return judged(docs, learn(labelled(docs, table(spark, sf_dir, "labels"))))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op11 and its base rules, without what is learned."""
    rows = counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *BASE, base_failed().alias("base_failed"))


QUALITY_COUNTS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS window_of FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
repeated AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, window_of) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM repeated, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c
"""
