import hashlib
import math
import random

import numpy as np
import pytest

from lexloom.llm import exponion as E

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v string, distance string"


def ids(vectors):
    """Places in the order of starting centroids; ties go by the components' bytes."""
    name = lambda i: "" if i is None else i
    return sorted(range(len(vectors)), key=lambda k: (vectors[k][0] is None, hashlib.sha256(f"3:{name(vectors[k][0])}".encode()).hexdigest(), np.array(vectors[k][1], dtype="<i4").tobytes()))


def plain(rows, clusters=8, rounds=10, components=64):
    """(vec_id, cluster, distance) of all kept rows, their inertias and digests, by the definition."""
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e)]
    centroids = [kept[i][1] for i in ids(kept)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda: [min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = nearest()
        for j in range(len(centroids)):
            if members := [v for (_, v), c in zip(kept, own, strict=True) if c == j]:
                centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = nearest()
    d = [far(v, centroids[c]) for (_, v), c in zip(kept, own, strict=True)]
    by = [sum(x for x, c in zip(d, own, strict=True) if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, x, by[c], sum(d), digest[c]) for (i, _), c, x in zip(kept, own, d, strict=True)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", "y", "z") for i, e in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_clusters(spark, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (6, 64))
    rows = [(7 * i, (middles[i % 6] * (seed != 2) + rng.normal(0, (0.05, 0.5, 1)[seed], 64)).tolist()) for i in range(240)]
    assert sorted(map(tuple, E.exponion(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_ties_and_repeated_rows(spark):
    """Components of one or two values only: most distances are equal, and many rows too."""
    random.seed(5)
    rows = [(i % 90, [random.choice([0.0, 1.0])] * 32 + [random.choice([-1.0, 0.0])] * 32) for i in range(160)]
    rows += [(200 + i, [0.5] * 64) for i in range(60)]
    # Rows of one id have hashes that tie, and go by their components.
    rows = list({i: (i, e) for i, e in rows}.values()) + [(500, [0.5] * 64)] * 40
    assert sorted(map(tuple, E.exponion(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_messy(spark):
    good = [[math.sin(i * j + 1) for j in range(64)] for i in range(5)]
    rows = [(i, e) for i, e in enumerate(good)] + [(None, good[0]), (None, [0.25] * 64)]
    bad = [(10, None), (11, []), (12, [1.0] * 63), (13, [1.0] * 65), (14, [None] + [1.0] * 63), (15, [math.nan] * 64), (16, [math.inf] + [0.0] * 63), (17, [2.0**18] + [0.0] * 63)]
    want = [(i, *rest) for i, *rest in plain(rows)]
    out = E.exponion(frame(spark, rows + bad))
    assert sorted(map(tuple, out.collect()), key=str) == want and len(want) == 7
    assert E.exponion(frame(spark, bad)).collect() == [] and E.exponion(frame(spark, bad).where("false")).collect() == []


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (8, 64))
    rows = [(i, (middles[i % 8] + rng.normal(0, 0.1, 64)).tolist()) for i in range(800)]
    state, centroids = E.clustered(frame(spark, rows), rounds=6)
    assert state.agg({"scanned": "sum"}).first()[0] < 800 and len(centroids) == 8


def test_every_round_is_the_nearest():
    """Rounds in one process, with centroids that move at random: against all distances."""
    rng = np.random.default_rng(2)
    rows = rng.integers(-40, 40, (3000, 8)).astype(np.int32)
    centroids, before = rng.integers(-40, 40, (12, 8)).tolist(), None
    cluster = upper = lower = None
    spared = 0
    for _ in range(12):
        search = E.Search(centroids, before)
        cluster, upper, lower, scanned = search.first(rows) if before is None else search.step(rows, cluster, upper, lower)
        all_of = ((rows[:, None, :].astype(np.int64) - np.array(centroids)) ** 2).sum(axis=2)
        assert (cluster == all_of.argmin(axis=1)).all()
        spared += int((scanned < 12).sum())
        before, centroids = centroids, (np.array(centroids) + rng.integers(-2, 3, (12, 8))).tolist()
    assert spared > 3000


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = E.op13_exponion(spark, sf)
    assert dict(out.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows)
