import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import embedding_dedup as E


def brute(rows, cosine=0.9):
    """(n_links, component_id, kept) of each row."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links, parent = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and (np.array_equal(unit[a], unit[b]) or float(unit[a] @ unit[b]) >= cosine):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    names = {}
    for i in good:
        if rows[i][0] is not None:
            names[find(i)] = min(rows[i][0], names.get(find(i), rows[i][0]))
    out = []
    for i, (vec_id, _) in enumerate(rows):
        c = names.get(find(i)) if i in unit else vec_id
        out.append((vec_id, links[i], c, vec_id is not None and vec_id == c))
    return out


def clusters(n=400, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.standard_normal(dim)
        rows.append(v)
        for spread in rng.choice([0.01, 0.2, 0.3, 0.6], rng.integers(0, 4)):
            rows.append(v + spread * rng.standard_normal(dim))
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


SPECIAL = [(5000, None), (5001, []), (5002, [0.0, 0.0]), (5003, [1.0, None]), (5004, [float("nan"), 1.0]), (5005, [float("inf"), 1.0]), (5006, [1.0, 0.0]), (5007, [2.0, 0.0]), (5007, [2.0, 0.0]), (5008, [1e30, 0.0]), (None, [1.0, 0.001]), (None, [0.0, 1.0]), (5009, [1e-30, 0.0])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("n", "id", "links", "tile", "component_id", "label")})


@pytest.mark.parametrize("tile", [8192, 100])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    rows = clusters() + SPECIAL
    got = [tuple(r) for r in E.near_duplicates(frame(spark, rows)).collect()]
    want = brute(rows)
    found, whole = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(want) and found <= whole and found >= 0.995 * whole
    if found == whole:
        assert sorted(got, key=str) == sorted(want, key=str)


def test_recall_at_the_threshold():
    """Pairs at the least cosine that counts, where collisions are rarest."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9 * a + math.sqrt(1 - 0.81) * b
    g = E.directions(64)
    hits = (np.abs(a @ g - c @ g) <= E.WINDOW).sum(1) >= E.least_count()
    other = (np.abs(a @ g - b @ g) <= E.WINDOW).sum(1) >= E.least_count()
    assert hits.mean() >= 0.99 and other.mean() <= 0.01
    for n in (E.BUCKET, 50_000, 10**7, 10**9):  # pairs of which a bucket of some table holds both
        tables, directions, sets = E.tables_for(n)
        shared = (E.buckets_of(a[:1000], tables, directions, sets) == E.buckets_of(c[:1000], tables, directions, sets)).any(1)
        assert shared.mean() >= 0.985, n


@pytest.mark.parametrize(("bucket", "tile"), [(64, 8192), (256, 50)])
def test_many_buckets_against_brute_force(spark, monkeypatch, bucket, tile):
    """Vectors of two lengths, dealt to several tables and buckets, some cut into tiles: no link is counted twice, few are lost."""
    monkeypatch.setattr(E, "BUCKET", bucket)
    monkeypatch.setattr(E, "TILE", tile)
    rows = clusters() + [(10_000 + i, v) for i, v in clusters(150, 40, 1)] + SPECIAL
    assert E.tables_for(len(rows))[0] > 2
    got = {i: r for i, r in enumerate(sorted((tuple(r) for r in E.near_duplicates(frame(spark, rows)).collect()), key=str))}
    want = {i: r for i, r in enumerate(sorted(brute(rows), key=str))}
    assert len(got) == len(want)
    found, whole = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert 0.995 * whole <= found <= whole
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)


def test_exact_has_every_link(spark, monkeypatch):
    """Of so many classes that tables of buckets would be approximate: pairs right at the threshold, and tiles."""
    monkeypatch.setattr(E, "BUCKET", 16)
    monkeypatch.setattr(E, "TILE", 128)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((150, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal((150, 32))
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.9005 * base + np.sqrt(1 - 0.9005**2) * away  # links that collide least often
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    want = brute(rows)
    assert sorted(map(tuple, E.near_duplicates(frame(spark, rows), exact=True).collect())) == sorted(want) and sum(r[1] for r in want) >= 300


def test_buckets_stay_small_and_tables_few():
    rng = np.random.default_rng(5)
    u = rng.standard_normal((20_000, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for n in (50_000, 10**6, 10**8, 10**10):
        tables, directions, sets = E.tables_for(n)
        assert tables <= 64 and n / (2 * directions) ** sets <= E.BUCKET
    tables, directions, sets = E.tables_for(10**5)
    for column in E.buckets_of(u, tables, directions, sets).T:
        assert np.bincount(column).max() <= 3 * len(u) / (2 * directions) ** sets


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = E.op9_embedding_dedup(spark, sf)
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))


def test_bit_sliced_counts():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((70, 32)), rng.standard_normal((130, 32))
    count = (np.abs(a[:, None, :] - b[None, :, :]) <= E.WINDOW).sum(2)
    for least in (1, 12, 16, 20, 32):
        got = {(at + int(x), int(y)) for at, i, j in E.passing(a, b, least) for x, y in zip(i, j, strict=True)}
        assert got == set(zip(*(x.tolist() for x in np.nonzero(count >= least)), strict=True))


def test_hot_vector(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(400, [0.99, 0.05, 0.0]), (401, [0.0, 0.0, 1.0])]
    got = {r["vec_id"]: tuple(r)[1:] for r in E.near_duplicates(frame(spark, rows)).collect()}
    assert got[7] == (300, 0, False) and got[0] == (300, 0, True) and got[400] == (300, 0, False) and got[401] == (0, 401, True)


def test_empty(spark):
    assert E.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in E.near_duplicates(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
