import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import mixing as M
from tests.llm.conftest import MESSY


def entropy(tokens, a):
    w = [t**a for t in tokens]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


def bisected(tokens, target, limit):
    lo, hi = 0.0, 1.0
    if entropy(tokens, 1.0) >= target * math.log(len(tokens)):
        lo = 1.0
    else:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if entropy(tokens, mid) >= target * math.log(len(tokens)) else (lo, mid)
    return max(lo, 1 - math.log(limit) / math.log(max(tokens) / min(tokens)), 0.0)


@pytest.mark.parametrize(("target", "limit"), [(0.9, 100.0), (0.99, 3.0), (0.5, 4.0), (1.0, 1000.0)])
def test_exponent(spark, target, limit):
    tokens = [1000, 200, 50, 40, 7]
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)] + [("none", 0)], "source string, tokens long")
    assert M.exponent(df, target, limit) == pytest.approx(bisected(tokens, target, limit), abs=1e-5)


def skewed(spark, n=6000):
    """A third of all rows in one source, and lengths that differ."""
    source = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 17).cast("string")))
    return spark.range(n).select(F.col("id").alias("doc_id"), source.alias("source"), F.repeat(F.lit("w "), (F.col("id") % 23).cast("int")).alias("text"))


def test_budgets_are_met(spark):
    docs = skewed(spark)
    rows = M.mixture(docs, target=0.97, max_repeats=2.5).collect()
    tokens, seen, epochs = Counter(), Counter(), defaultdict(Counter)
    for r in docs.collect():
        tokens[r["source"]] += len(r["text"].split())
    for r in rows:
        seen[r["source"]] += r["tokens"]
        epochs[r["doc_id"]][r["epoch"]] += 1
    alpha = bisected(list(tokens.values()), 0.97, 2.5)
    most = max(tokens.values())
    for s, t in tokens.items():
        assert abs(seen[s] - t * (t / most) ** (alpha - 1)) <= 25  # a document's tokens
    assert 1.2 < max(seen[s] / tokens[s] for s in tokens) <= 2.51 and seen["hot"] == tokens["hot"]
    assert len(epochs) == 6000 and all(set(e) == set(range(len(e))) and set(e.values()) == {1} for e in epochs.values())


def test_partial_epochs_are_whole_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DOCS", 16)
    rows = M.schedule(skewed(spark, 3000), target=0.97, max_repeats=2.5).collect()
    by_block = defaultdict(set)
    for r in rows:
        by_block[r["source"], r["block"]].add(r["last"])
    mixed = Counter(s for (s, _), v in by_block.items() if len(v) == 2)
    assert len(by_block) > 50 and max(mixed.values(), default=0) <= 1 and any(v == {True} for v in by_block.values())


def test_messy(messy, nothing):
    out = M.mixed(messy, target=1.0, max_repeats=3.0)
    assert out.columns == messy.columns
    want = Counter((d, t) for d, t, *_ in MESSY)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert set(got) == set(want) and all(want[k] <= got[k] <= 3 * want[k] for k in want)
    assert M.mixture(nothing).count() == 0 and M.mixed(nothing).count() == 0


def test_rows_without_an_id_are_units_of_their_own(spark):
    """And so are rows that share an id and not a text; a third of all rows have none."""
    rows = [(None, f"w {'x ' * (i % 7)}{i}", "small") for i in range(300)] + [(5, f"y {i}", "small") for i in range(60)] + [(1000 + i, "z " * 40, "big") for i in range(540)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = Counter((r["doc_id"], r["text"]) for r in M.mixed(docs, 1.0, 2.5).collect())
    own = [n for (d, t), n in out.items() if t[0] != "z"]
    assert len(own) == 360 and set(own) == {2, 3} and 60 < own.count(3) < 300
    assert {n for (_, t), n in out.items() if t[0] == "z"} == {1}
    again = Counter((r["doc_id"], r["text"]) for r in M.mixed(docs.repartition(2), 1.0, 2.5).collect())
    assert again == out


def test_texts_are_not_shuffled(spark):
    plan = M.mixed(skewed(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_very_many_sources(spark, monkeypatch):
    want = sorted(map(tuple, M.mixed(skewed(spark)).collect()))
    monkeypatch.setattr(M, "SOURCES", 2)
    assert sorted(map(tuple, M.mixed(skewed(spark)).collect())) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables_are_mixed(spark, sf):
    """The exponent acts: the entropy is half-way up to the largest, and small sources are seen again in part."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    tokens, seen, times, epochs = Counter(), Counter(), Counter(), defaultdict(Counter)
    for r in docs.collect():
        tokens[r["source"]] += len((r["text"] or "").encode().split())
        times[r["doc_id"]] += 1
    for r in M.mixture(docs).collect():
        seen[r["source"]] += r["tokens"]
        epochs[r["doc_id"]][r["epoch"]] += 1
    natural = entropy(list(tokens.values()), 1.0) / math.log(len(tokens))
    alpha = bisected(list(tokens.values()), natural + M.CLOSING * (1 - natural), M.MAX_REPEATS)
    assert alpha < 0.95 and max(e for own in epochs.values() for e in own) >= 1
    longest = max(len((r["text"] or "").split()) for r in docs.collect())
    for s, t in tokens.items():
        assert 0 <= t * (t / max(tokens.values())) ** (alpha - 1) - seen[s] + 1 <= longest + 2
    assert all(set(e) == set(range(len(e))) and set(e.values()) == {1} for e in epochs.values()) and len(epochs) == len(times)


def test_no_tokens(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["epoch"]) for r in M.mixture(df).collect()) == [(1, 0), (2, 0)]
