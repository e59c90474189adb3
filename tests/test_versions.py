"""Lexicons by date, and models fitted to labels, against plain versions."""

import bisect
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import features as feat
from lexloom.operators import fitting
from lexloom.operators import profile as P
from lexloom.operators import running as R
from lexloom.operators import versions as V


@pytest.mark.parametrize(("few", "dates"), [(1024, 100_000), (16, 0)])
def test_as_of(spark, monkeypatch, few, dates):
    monkeypatch.setattr(R.running, "__defaults__", (few,))
    monkeypatch.setattr(V, "DATES", dates)
    rng = random.Random(2)
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    firsts = sorted({rng.randrange(20, 300) for _ in range(9)})
    rows = [(i, day(rng.choice([rng.randrange(320), 77])) if i % 11 else None) for i in range(600)]
    versions = spark.createDataFrame([(str(day(n)), f"v{k}") for k, n in enumerate(firsts)] + [(str(day(firsts[3])), "a lesser name"), (None, "never")], "first string, version string")
    out = V.as_of(spark.createDataFrame(rows, "id long, d date").repartition(4), F.col("d"), versions)
    assert out.columns == ["id", "d", "version"]
    for r in out.collect():
        k = -1 if r["d"] is None else bisect.bisect_right(firsts, (r["d"] - day(0)).days) - 1
        assert r["version"] == (None if k < 0 else f"v{k}")
    assert out.count() == 600 and V.as_of(out.drop("version").where("false"), F.col("d"), versions).count() == 0


def test_features_by_version(spark):
    one, two = [("a", "x", 1), ("b", "y", 2)], [("a", "y", 1), ("c", "x", 3)]
    rows = [(1, "x y z", "2024-01-15"), (2, "x y z", "2024-02-01"), (3, "x y z", "2023-12-31"), (4, "x y z", None), (5, "x y z", "2024-02-30"), (6, None, "2024-03-01")]
    out = V.features(spark.createDataFrame(rows, "doc_id long, text string, source_date string"), {"one": ("2024-01-01", one), "two": ("2024-02-01", two)})
    got = {r["doc_id"]: (r["version"], r["word_count"], round(r["coverage"], 3), round(r["pct_a"]), round(r["pct_b"]), round(r["pct_c"])) for r in out.collect()}
    assert got == {1: ("one", 3, 0.667, 33, 67, 0), 2: ("two", 3, 0.667, 33, 0, 100), 3: (None, 3, 0, 0, 0, 0), 4: (None, 3, 0, 0, 0, 0), 5: (None, 3, 0, 0, 0, 0), 6: ("two", 0, 0, 0, 0, 0)}


def test_ridge_is_that_of_a_plain_solver(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (500, 6)) * [1, 10, 0.1, 5, 1, 1]
    y = x @ [0.3, -0.02, 1.0, 0.0, 0.5, -0.5] + 0.4 + rng.normal(0, 0.1, 500)
    names = [f"pct_{i}" for i in range(6)]
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, *[1.0] * 6), (float("nan"), *[1.0] * 6), (*[1.0] * 6, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])).repartition(5)
    for penalty in (1.0, 50.0):
        full = np.column_stack([np.ones(500), x])
        want = np.linalg.solve(full.T @ full + penalty * np.diag([0.0] + [1.0] * 6), full.T @ y)
        got = fitting.ridge(df, names, "y", penalty)
        assert list(got) == ["", *names] and np.allclose(list(got.values()), want, rtol=1e-9)
    assert set(fitting.ridge(df.where("false"), names, "y").values()) == {0.0}


def test_a_fitted_model_scores_documents(spark):
    """Against labels of quality: better than the mean alone, and the score is the clamped sum."""
    sf = "/root/testdata/sf0.01"
    from lexloom.plans import queries as Q

    feats = feat.features(Q.docs(spark, sf), Q.lex())
    names = [c for c in feats.columns if c.startswith("pct_")]
    rows = feats.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "quality", *names).collect()
    x, y = np.array([[1.0, *[r[n] for n in names]] for r in rows]), np.array([r["quality"] for r in rows], dtype=float)
    theta = np.linalg.solve(x.T @ x + np.diag([0.0] + [1.0] * len(names)), x.T @ y)
    got = {r["doc_id"]: r["fitted"] for r in Q.fitted_scores(spark, sf).collect()}
    assert len(got) == 1000 and all(abs(got[r["doc_id"]] - min(max(v, 0), 1)) < 0.00501 for r, v in zip(rows, x @ theta, strict=True))
    assert np.mean((np.array([got[r["doc_id"]] for r in rows]) - y) ** 2) < y.var()  # than the mean alone: invented prose has few words of the lexicon
    with pytest.raises(ValueError, match="not traits"):
        P.scores(feats, {"quality": fitting.score({"": 0.0})})
