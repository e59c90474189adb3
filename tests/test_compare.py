"""Ranks, groups and courses against plain versions, with hot keys, ties and nulls."""

import random
from collections import defaultdict

import pytest

from lexloom.operators import compare as C
from lexloom.operators import features as feat
from lexloom.operators import running as R
from lexloom.sources import lexicon as L


@pytest.mark.parametrize(("few", "values"), [(1024, 100_000), (16, 0)])
def test_ranks(spark, monkeypatch, few, values):
    monkeypatch.setattr(R.running, "__defaults__", (few,))
    monkeypatch.setattr(C, "VALUES", values)
    rng = random.Random(3)
    rows = [("hot", i, rng.random()) for i in range(700)] + [("hot", 1000 + i, 0.5) for i in range(300)] + [(None, 2000 + i, rng.choice([0.1, 0.2, None])) for i in range(40)] + [("one", 3000, 0.3), ("none", 3001, None)]
    df = spark.createDataFrame(rows, "k string, id long, v double").repartition(5)
    own = defaultdict(list)
    for k, _, v in rows:
        if v is not None:
            own[k].append(v)
    got = C.ranked(df, ["k"], "v")
    assert got.columns == ["k", "id", "v", "percent_rank", "cume_dist"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        n = len(own[r["k"]])
        if r["v"] is None:
            assert r["percent_rank"] is None and r["cume_dist"] is None
        else:
            less, same = sum(x < r["v"] for x in own[r["k"]]), own[r["k"]].count(r["v"])
            assert r["percent_rank"] == (less / (n - 1) if n > 1 else 0.0) and r["cume_dist"] == (less + same) / n


@pytest.mark.parametrize("few", [1024, 16])
def test_courses_and_changes(spark, monkeypatch, few):
    monkeypatch.setattr(R.running, "__defaults__", (few,))
    rng = random.Random(5)
    rows = [("hot", i, rng.randrange(101) / 100 * (0.5 if i < 300 else 1)) for i in range(800)] + [(None, i, rng.choice([0.25, 0.5, None])) for i in range(30)] + [("one", 1, 0.5), ("same", 1, 0.5), ("same", 2, 0.5), ("two", 1, 0.1), ("two", 2, 0.9)]
    rows = [(k, i, None if v is None else round(v, 2)) for k, i, v in rows]
    df = spark.createDataFrame(rows, "k string, at long, v double").repartition(4)
    by = defaultdict(list)
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        by[k].append((i, v))
    got = {(r["k"], r["at"]): r for r in C.courses(df, "k", "at", "v").collect()}
    assert len(got) == len(rows)
    for k, own in by.items():
        for n, (i, v) in enumerate(own, 1):
            last = [round(x * 100) for _, x in own[max(0, n - 3) : n] if x is not None]
            r = got[k, i]
            assert r["n"] == n and r["recent"] == (sum(last) / len(last) / 100 if last else None)
            before = own[n - 2][1] if n > 1 else None
            assert r["step"] == (None if v is None or before is None else (round(v * 100) - round(before * 100)) / 100)
    want = set()
    for k, own in by.items():
        known = [(i, round(v * 100)) for i, v in own if v is not None]
        n, total = len(known), sum(c for _, c in known)
        sums = [(abs(n * s - m * total), -m, s) for m in range(1, n) for s in [sum(c for _, c in known[:m])]]
        far, m, s = max(sums, default=(0, 0, 0))
        if far:
            want.add((k, n, -m, known[-m - 1][0], s / -m / 100, (total - s) / (n + m) / 100))
    assert {tuple(r) for r in C.changes(df, "k", "at", "v").collect()} == want and {w[0] for w in want} == {"hot", None, "two"}
    assert next(w for w in want if w[0] == "two")[2] == 1


def test_groups_are_sums(spark):
    """Each group's scores are those of its texts as one document; null values are values."""
    rows = [(1, "happy think", "a", "en"), (2, "sad always I", "a", None), (3, None, None, "en"), (4, "goal the the", "b", "en"), (5, "xyz", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {(r["level"], r["source"], r["lang"]): (r["word_count"], r["coverage"], r["openness"], r["clout"]) for r in C.grouped(df, L.load(), ["source", "lang"], [["source", "lang"], ["source"], ["lang"], []]).collect()}
    want = {}
    for level, pick in ((0, (2, 3)), (1, (2,)), (2, (3,)), (3, ())):
        texts = defaultdict(list)
        for r in rows:
            texts[tuple(r[k] if k in pick else None for k in (2, 3))].append(r[1] or "")
        for (source, lang), own in texts.items():
            one = spark.createDataFrame([(1, "\n\n".join(own))], "doc_id long, text string")
            r = C.scores(feat.features(one, L.load())).first()
            want[level, source, lang] = r["word_count"], r["coverage"], r["openness"], r["clout"]
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "k string, at long, v double, text string")
    assert C.ranked(df, ["k"], "v").count() == 0 and C.courses(df, "k", "at", "v").count() == 0 and C.changes(df, "k", "at", "v").count() == 0
