"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on PROJECTIONS random directions. Two vectors at cosine c are at
distance s = sqrt(2 - 2c), so their projections differ by a normal variable of deviation s: by
WINDOW or less with a probability that is known. The least number of collisions that a pair
must have follows from the binomial distribution and the recall asked for at the threshold's
cosine; pairs above it collide more often. Pairs that pass are verified in double precision.

Equal vectors become one class first. Of further random directions a class takes, in each of a
few tables, the one on which its projection is furthest out, with the sign: its bucket. Linked classes
share one with a probability that depends on the cosine and the number of directions only, so the
number of tables follows from a recall too. More classes take more directions, so a bucket keeps about
BUCKET classes and the work and the shuffle of a class grow with the tables, not with the classes.
Few classes are one bucket of one table, and no link is lost there.

In a bucket, each direction's values are sorted, the window around a query is two ranks, and the
candidates between them are two rows of a table of prefix bit sets, one xor; collisions of 64
candidates are added at once in bit-sliced counters. A pair counts in the first table whose bucket it
shares. A bucket over TILE is cut into tiles whose pairs are compared apart; only classes that all
lie close together make one. A task gives link counts and a spanning forest, never the pairs.

Cases: vectors that are null, empty, zero, or hold a null or non-finite component have no links and
are their own component; vectors of different lengths are not linked; vectors without an id count as
links of others but name no component; repeated rows are vectors of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import spread_join, staged, table
from lexloom.llm.components import Forest, components

COSINE, PROJECTIONS, WINDOW, RECALL, SEED = 0.9, 32, 0.75, 0.999, 17
#: Classes that a bucket should have, that one task compares at most, and the recall of the tables.
BUCKET, TILE, SHARED = 4096, 8192, 0.998
#: Directions of a table at most; more buckets than these give are pairs of directions.
DIRECTIONS = 512
ROWS, CHECKED = 512, 1 << 21


# --- calibration ---------------------------------------------------------------------------


def collision_rate(cosine: float, window: float = WINDOW) -> float:
    """The probability that the projections of two unit vectors differ by ``window`` or less."""
    spread = math.sqrt(max(2 - 2 * cosine, 0))
    return math.erf(window / spread / math.sqrt(2)) if spread else 1.0


def least_count(cosine: float = COSINE, recall: float = RECALL, projections: int = PROJECTIONS, window: float = WINDOW) -> int:
    """The most collisions to ask for that keep ``recall`` of the pairs at ``cosine``."""
    p, tail = collision_rate(cosine, window), 0.0
    for count in range(projections, 0, -1):
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= recall:
            return count
    return 0


@cache
def shared_rate(n: int, cosine: float = COSINE, pairs: int = 40_000) -> float:
    """The probability that two unit vectors are furthest out on the same one of ``n`` directions, on the same side: by simulation, three deviations less."""
    rng = np.random.default_rng(SEED)
    hits = 0
    for _ in range(0, pairs, 2000):
        a = rng.standard_normal((2000, n))
        hits += int((outermost(a) == outermost(cosine * a + math.sqrt(1 - cosine**2) * rng.standard_normal((2000, n)))).sum())
    p = hits / pairs
    return p - 3 * math.sqrt(p * (1 - p) / pairs)


def tables_for(classes: int, cosine: float = COSINE, shared: float = SHARED) -> tuple[int, int, int]:
    """(tables, directions, of how many sets of directions a bucket is the outermost ones) for so many classes."""
    buckets = -(-classes // BUCKET)
    if buckets <= 2:
        return 1, 0, 1
    sets = 1
    while (2 * DIRECTIONS) ** sets < buckets:
        sets += 1
    n = math.ceil(buckets ** (1 / sets) / 2)
    p = shared_rate(n, cosine) ** sets
    return math.ceil(math.log(1 - shared) / math.log(1 - p)), n, sets


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((projections, dim)).T


def outermost(projected: np.ndarray) -> np.ndarray:
    """For each row the place of the value furthest from 0, times two, and one more where it is positive."""
    at = np.abs(projected).argmax(axis=1)
    return 2 * at + (projected[np.arange(len(at)), at] > 0)


def buckets_of(u: np.ndarray, tables: int, n: int, sets: int) -> np.ndarray:
    """The bucket of each row of ``u`` in each table."""
    out = np.zeros((len(u), tables), dtype=np.int64)
    if n:
        for t in range(tables):
            for k in range(sets):
                g = np.random.default_rng([SEED, t, k]).standard_normal((n, u.shape[1])).T
                out[:, t] = out[:, t] * 2 * n + outermost(u @ g)
    return out


# --- comparison of two tiles ---------------------------------------------------------------


def _count(planes: list[np.ndarray], mask: np.ndarray) -> None:
    """Adds the bits of ``mask`` to the bit-sliced counters ``planes``."""
    for k in range(len(planes)):
        planes[k], mask = planes[k] ^ mask, planes[k] & mask
        if not mask.any():
            return


def _at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    above, equal = np.zeros_like(planes[0]), np.full_like(planes[0], 2**64 - 1)
    for k in range(len(planes) - 1, -1, -1):
        if least >> k & 1:
            equal &= planes[k]
        else:
            above |= equal & planes[k]
            equal &= ~planes[k]
    return above | equal


def passing(a: np.ndarray, b: np.ndarray, least: int, window: float = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(at, i, j): pairs (at + i, j) of the rows of the projections ``a`` and ``b`` that collide ``least`` times or more."""
    words = -(-len(b) // 64)
    planes = [np.zeros((len(a), words), dtype=np.uint64) for _ in range(a.shape[1].bit_length())]
    for m in range(a.shape[1]):
        order = np.argsort(b[:, m], kind="stable")
        values = b[order, m]
        prefix = np.zeros((len(b) + 1, words), dtype=np.uint64)
        prefix[np.arange(1, len(b) + 1), order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
        np.bitwise_xor.accumulate(prefix, axis=0, out=prefix)
        lo, hi = np.searchsorted(values, a[:, m] - window), np.searchsorted(values, a[:, m] + window, side="right")
        _count(planes, prefix[hi] ^ prefix[lo])
    found = _at_least(planes, least)
    for at in range(0, len(a), ROWS):
        bits = np.unpackbits(found[at : at + ROWS].astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(b)]
        i, j = np.nonzero(bits)
        if len(i):
            yield at, i, j


def compare(u: np.ndarray, v: np.ndarray | None, n: np.ndarray, cosine: float, least: int, keys: np.ndarray) -> tuple[np.ndarray, Forest]:
    """Links of each class (rows of ``u``, then of ``v``; ``n`` vectors each), between the two or, without ``v``, within ``u``.

    ``keys``: the classes' buckets in earlier tables, where pairs that share one have been counted.
    """
    g = directions(u.shape[1])
    other, shift = (u, 0) if v is None else (v, len(u))
    links, forest, step = np.zeros(len(n), dtype=np.int64), Forest(len(n)), max(1, CHECKED // u.shape[1])
    for at, i, j in passing(u @ g, other @ g, least):
        if v is None:
            keep = j > i + at
            i, j = i[keep], j[keep]
        for k in range(0, len(i), step):
            x, y = i[k : k + step] + at, j[k : k + step]
            for t in range(keys.shape[1]):
                new = keys[x, t] != keys[y + shift, t]
                x, y = x[new], y[new]
            good = np.einsum("ij,ij->i", u[x], other[y]) >= cosine
            x, y = x[good], y[good] + shift
            links += np.bincount(x, weights=n[y], minlength=len(n)).astype(np.int64) + np.bincount(y, weights=n[x], minlength=len(n)).astype(np.int64)
            forest.link(x, y)
    return links, forest


# --- on Spark ------------------------------------------------------------------------------


def unit(column: pa.ListArray, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def with_buckets(classes: DataFrame, tables: int, n: int, sets: int) -> DataFrame:
    """``classes`` (id, n, embedding, dim) with ``keys``, their buckets by table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = np.asarray(batch.column("dim")), np.zeros((batch.num_rows, tables), dtype=np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                keys[rows] = buckets_of(unit(batch.column("embedding").take(pa.array(rows)), int(dim)), tables, n, sets)
            own = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "keys"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{schema}, keys array<long>")


def dealt(classes: DataFrame) -> DataFrame:
    """``classes`` (id, n, embedding, dim, keys), each in its bucket of every table, sorted by (dim, t, key, pair); ``pair``: of tiles."""
    rows = classes.select("id", "n", "embedding", "dim", "keys", F.posexplode("keys").alias("t", "key"))
    large = rows.groupBy("dim", "t", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > TILE)
    rows = rows.join(large, ["dim", "t", "key"], "left").withColumn("tiles", F.ceil(F.coalesce("rows", F.lit(1)) / TILE).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.least(x, F.col("tile")) * F.col("tiles") + F.greatest(x, F.col("tile")))
    # Of the keys only those of earlier tables are needed.
    rows = rows.select("dim", "t", "key", F.explode(pairs).alias("pair"), "tile", "id", "n", "embedding", F.slice("keys", F.lit(1), F.col("t")).alias("keys"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "dim", "t", "key", "pair").sortWithinPartitions("dim", "t", "key", "pair")


def _compare_buckets(cosine: float, least: int):
    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(held).combine_chunks()
        if whole.num_rows < 2:
            return None
        tile = np.asarray(whole.column("tile"))
        order = np.argsort(tile, kind="stable")
        whole, tile = whole.take(pa.array(order)), tile[order]
        t, dim = int(whole.column("t")[0].as_py()), int(whole.column("dim")[0].as_py())
        x = unit(whole.column("embedding").combine_chunks(), dim)
        keys = whole.column("keys").combine_chunks().flatten().to_numpy().reshape(len(x), t)
        ids, n, cut = np.asarray(whole.column("id")), np.asarray(whole.column("n")), int(np.searchsorted(tile, tile[0], side="right"))
        links, forest = compare(x[:cut], x[cut:] if cut < len(x) else None, n, cosine, least, keys)
        member, root = forest.edges()
        some = np.flatnonzero(links)
        none = pa.nulls(len(some), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(ids[some]), pa.array(ids[member])]), pa.concat_arrays([none, pa.array(ids[root])]), pa.concat_arrays([pa.array(links[some]), pa.nulls(len(member), pa.int64())])],
            names=["a", "b", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            columns = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("dim", "t", "key", "pair")], axis=1)
            starts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), len(columns)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if held and tuple(columns[a]) != bucket:
                    if (found := of(held)) is not None:
                        yield found
                    held = []
                held.append(batch.slice(a, b - a))
                bucket = tuple(columns[a])
        if held and (found := of(held)) is not None:
            yield found

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, shared: float = SHARED, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    ``recall`` is that of the count of collisions, ``shared`` that of the bucket tables. ``exact``: all classes are one bucket, cut
    into tiles, and every pair of tiles is verified whatever its collisions: no link is lost, at a cost that grows with the square of the classes.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # Equal vectors are told by 128 bits of hashes; only these are joined, never the vectors.
    hashes = [F.xxhash64(F.lit(k), "embedding").alias(f"h{k}") for k in (1, 2)]
    own = rows.where(good).select("vec_id", *hashes, "embedding")
    classes = own.groupBy("h1", "h2").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    # Classes that have no id get a negative one that no other class is likely to have.
    unnamed = F.lit(-(2**62)) - F.pmod(F.col("h1"), F.lit(2**61))
    classes = staged(classes.select(F.coalesce("smallest", unnamed).alias("id"), "smallest", "n", "h1", "h2", F.size("embedding").alias("dim"), "embedding"), "classes")
    bucketed = staged(with_buckets(classes.select("id", "n", "dim", "embedding"), *((1, 0, 1) if exact else tables_for(classes.count(), cosine, shared))), "bucketed")
    least = 0 if exact else least_count(cosine, recall)
    found = staged(dealt(bucketed).mapInArrow(_compare_buckets(cosine, least), "a long, b long, links long"), "links")
    counts = found.where("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    groups = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "id")
    named = classes.select("id", "n", "smallest", "h1", "h2").join(counts, "id", "left").join(groups, "id", "left")
    named = staged(named.select("h1", "h2", "smallest", F.col("n").alias("rows"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "named")
    names = staged(named.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count("*").alias("n")), "names")
    named = staged(spread_join(named, names, ["component"]).select("h1", "h2", F.col("rows").alias("n"), "n_links", "component_id"), "classes_named")
    known = spread_join(own.drop("embedding"), named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = known.unionByName(rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and components of all vectors."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
