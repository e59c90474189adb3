"""Centroid clustering of integer vectors, by exponion search.

A vector carries its centroid, an upper bound of the distance to it and a lower bound of the
distance to any other. Moves of the centroids loosen the bounds; a vector is looked at only if they
overlap even after its own distance is computed anew. Then no centroid as near as its own is
farther from its own than twice that distance, and no second one farther than that and the gap
to its centroid's next neighbour: so it scans the centroids in that ball, a prefix of its centroid's
sorted list. The radius is inclusive and bounds are rounded outwards, so ties are seen, and go to the smaller number.

Distances are squared sums of 64-bit integers, without rounding. A round writes the table of vectors
with their bounds anew, without a shuffle, and deletes the one before; only sums over the vectors
that changed their centroid, one row for each centroid and component, are shuffled and reach the driver.

Cases: vectors that are null, of another length, or hold a null or non-finite component are left
out, and so are those with a component of 2 ** 27 or more after scaling, whose distances 64 bits can't
hold; vectors without an id are clustered, but start a centroid only where there are too few others;
repeated rows are vectors of their own; with fewer vectors than centroids each starts one, and of equal
centroids the later ones stay empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import file_system, new_path, table

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components must be smaller, so that squared distances of 64 components fit 64 bits; vectors at once.
LIMIT, ROWS = 1 << 27, 8192
#: Upper bounds grow by this factor where they are computed, and lower ones shrink: more than floats round.
OUTWARDS = 1e-12
STATE = "vec_id long, v binary, cluster int, upper double, lower double, before int, moved boolean, scanned int"


def whole(vectors: pa.ListArray, components: int = COMPONENTS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``vectors`` (lists of doubles) are kept, and these as integers, a row each."""
    offsets, valid = vectors.offsets.to_numpy(), vectors.is_valid().to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(valid & (np.diff(offsets) == components))
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    rows = values[offsets[keep][:, None] + np.arange(components)]
    with np.errstate(over="ignore", invalid="ignore"):
        rows = np.floor(rows * scale)
        good = (np.abs(rows) < LIMIT).all(axis=1)
    return keep[good], rows[good].astype(np.int32)


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = rows.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", gap, gap)


def up(x):
    return x * (1 + OUTWARDS)


def down(x):
    return x * (1 - OUTWARDS * np.sign(x))


class Search:
    """One round's centroids, their distances to one another, and how far they have moved."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        self.centroids = np.array(centroids, dtype=np.int64)
        k = len(centroids)
        self.moves = np.array([up(np.sqrt(float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))))) for x, y in zip(centroids, before, strict=True)]) if before else np.zeros(k)
        between = np.array([[np.sqrt(float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)))) for y in centroids] for x in centroids])
        self.order = np.argsort(between, axis=1, kind="stable")
        # Of equal centroids each must come first in its own list.
        self.order = np.array([[i, *(j for j in row if j != i)] for i, row in enumerate(self.order.tolist())], dtype=np.int64)
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        self.gap = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        # The largest move of any centroid but one's own.
        self.others = np.array([max((self.moves[j] for j in range(k) if j != i), default=0.0) for i in range(k)])

    def first(self, rows: np.ndarray):
        """All centroids, for vectors without bounds."""
        n, k = len(rows), len(self.centroids)
        return (*self._nearest(rows, np.zeros(n, dtype=np.int64), np.full(n, k)), np.full(n, k, dtype=np.int32))

    def _nearest(self, rows, own, counts):
        """Of the first ``counts`` centroids in the list of each one's ``own``: the nearest, its bounds."""
        n, most = len(rows), np.iinfo(np.int64).max
        best, second, number = np.full(n, most), np.full(n, most), np.full(n, len(self.centroids), dtype=np.int64)
        for at in range(int(counts.max(initial=0))):
            live = np.flatnonzero(counts > at)
            j = self.order[own[live], at]
            d = squared(rows[live], self.centroids[j])
            better = (d < best[live]) | (d == best[live]) & (j < number[live])
            second[live] = np.where(better, best[live], np.minimum(second[live], d))
            best[live], number[live] = np.where(better, d, best[live]), np.where(better, j, number[live])
        lower = np.where(second == most, np.inf, down(np.sqrt(second.astype(np.float64))))
        return number, up(np.sqrt(best.astype(np.float64))), lower

    def step(self, rows: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """(cluster, upper, lower, scanned) of the round; scanned: distances that were computed."""
        cluster, scanned = cluster.astype(np.int64), np.zeros(len(rows), dtype=np.int32)
        upper, lower = up(upper + self.moves[cluster]), down(lower - self.others[cluster])
        lower = np.maximum(lower, down(down(self.gap[cluster]) - upper))  # d(x, j) >= d(own, j) - d(x, own)
        near = np.flatnonzero(upper >= lower)
        upper[near] = up(np.sqrt(squared(rows[near], self.centroids[cluster[near]]).astype(np.float64)))
        scanned[near] = 1
        near = near[upper[near] >= lower[near]]
        if len(near):
            own, at = cluster[near], upper[near]
            ball = up(2 * at + self.gap[own])
            counts = np.zeros(len(near), dtype=np.int64)
            for a in np.unique(own).tolist():
                counts[own == a] = np.searchsorted(self.sorted[a], ball[own == a], side="right")
            number, best, second = self._nearest(rows[near], own, counts)
            cluster[near], upper[near] = number, best
            # Whatever is outside the ball is at least the ball's radius less the old distance away.
            lower[near] = np.minimum(second, np.where(counts < len(self.centroids), down(down(ball) - at), np.inf))
            scanned[near] += counts.astype(np.int32)
        return cluster, upper, lower, scanned


# --- on Spark ------------------------------------------------------------------------------


def kept(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of ``vectors`` (vec_id, embedding): integers of 32 bits, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = whole(batch.column("e"), components, scale)
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), packed], names=["vec_id", "v"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return own.mapInArrow(run, "vec_id long, v binary")


def starts(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The first centroids: vectors in the order of their ids' hashes, then of their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(F.col("vec_id").isNull(), name, "v").limit(clusters).select("v").collect()
    return [np.frombuffer(r["v"], dtype="<i4").tolist() for r in first]


def unpacked(batch: pa.RecordBatch, components: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype="<i4").reshape(-1, components)


def assigned(state: DataFrame, centroids: list[list[int]], before: list[list[int]] | None) -> DataFrame:
    """The next round's state of all vectors; the first, without ``before``, from (vec_id, v)."""
    components = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                rows = unpacked(batch, components)
                old = np.full(len(rows), -1) if before is None else batch.column("cluster").to_numpy()
                new = search.first(rows) if before is None else search.step(rows, old, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
                cluster, upper, lower, scanned = new
                columns = [cluster.astype(np.int32), upper, lower, old.astype(np.int32), cluster != old, scanned]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *map(pa.array, columns)], names=["vec_id", "v", "cluster", "upper", "lower", "before", "moved", "scanned"])

    return state.mapInArrow(run, STATE)


def change(state: DataFrame, components: int) -> list:
    """By centroid and component, what vectors that moved add to its sum (component -1: to its count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = np.concatenate([np.ones((batch.num_rows, 1), dtype=np.int64), unpacked(batch, components)], axis=1)
            for column, sign in (("cluster", 1), ("before", -1)):
                number = batch.column(column).to_numpy()
                for c in np.unique(number[number >= 0]).tolist():
                    sums[c] = sums.get(c, 0) + sign * rows[number == c].sum(axis=0)
        at = np.arange(-1, components)
        for c, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(components + 1, c)), pa.array(at), pa.array(own)], names=["c", "at", "n"])

    moved = state.where("moved").select("v", "cluster", "before")
    return moved.mapInArrow(run, "c long, at long, n long").groupBy("c", "at").agg(F.sum("n").alias("n")).collect()


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(state of all kept vectors after ``rounds`` rounds and one more assignment, their centroids)."""
    spark = vectors.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "vectors")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    state, path = write(kept(vectors, components, scale))
    centroids, before = starts(state, clusters, seed), None
    if not centroids:
        return spark.createDataFrame([], STATE), []
    sums = [[0] * (components + 1) for _ in centroids]
    for number in range(rounds + 1):
        old = path
        state, path = write(assigned(state, centroids, before))
        own, fs = file_system(spark, old)
        fs.delete(own, True)  # the round that is written doesn't need it
        if number == rounds:
            break
        for r in change(state, components):
            sums[r["c"]][r["at"] + 1] += r["n"]
        before, centroids = centroids, [[x // n for x in own] if n else c for c, (n, *own) in zip(centroids, sums, strict=True)]
    return state, centroids


def distances(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance): the exact squared distance to one's own centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(centroids, dtype=np.int64)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                d = squared(unpacked(batch, own.shape[1]), own[batch.column("cluster").to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")


def exponion(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    state, centroids = clustered(vectors, clusters, rounds, seed, components, scale)
    rows = distances(state, centroids)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    named = [(i, sums.get(i, 0), sum(sums.values()), digest(c)) for i, c in enumerate(centroids)]
    names = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector."""
    return exponion(table(spark, sf_dir, "embeddings"))


def clusters_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same by all distances, round after round, for DuckDB."""
    parts = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE) AND abs(floor({scale} * x::DOUBLE)) < {LIMIT})) = {components})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id IS NULL, sha256('{seed}:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS c, v FROM e ORDER BY c LIMIT {clusters})",
    ]
    for k in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, vec_id, e.v, c.c, {far} AS d FROM e, c{k} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c.c) = 1)")
        if k < rounds:
            mean = "list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[]"
            sums = f"SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY c, i"
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{k} o LEFT JOIN (SELECT c, {mean} AS v FROM ({sums}) GROUP BY c) m USING (c))")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} o USING (c)"""
