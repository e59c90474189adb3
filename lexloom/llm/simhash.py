"""SimHash near-duplicates, compared in bit slices.

Distinct fingerprints are dealt to tables of block combinations: of ``b`` blocks of the 64
bits, ``radius`` differing bits spare ``b - radius``, so two linked fingerprints agree on some
combination of that many blocks. Within a bucket the bits are stored vertically, one plane a
bit position with a candidate a bit; the planes of a query's differences are added to the
counters of 64 candidates at once by carry-save adders, and a block of 64 is abandoned once
all of its counters exceed the radius. A bucket gives a spanning forest of its links and no
more, and the components follow on Spark. More fingerprints take more blocks, so buckets stay
small; none of these choices loses a link.

Cases: a null text is the empty text, with fingerprint 0; documents without an id are linked
like any other, but never name a component (one that has no ids has none), and deduplication
keeps one of them besides the one with an id; repeated rows each get a result; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import slices, spread_join, staged, table
from lexloom.llm.components import Forest, components

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints that a bucket should have at most by its expected size, and that one task compares at once.
BUCKET, TILE = 4096, 32768
#: Blocks of 64 candidates that are compared at once.
LIVE = 1 << 16
#: Blocks whose pairs are spelled out at once.
SPELLED = 1 << 12


# --- fingerprints --------------------------------------------------------------------------


def simhash(text: bytes, k: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8: bit i is 1 if it is in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and \x20 \x09-\x0d
    if not words:
        return 0
    line, ends = memoryview(b" ".join(words)), np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(len(words) - k + 1, 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[k - 1 :].tolist() if len(words) >= k else [len(line)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = WORDS, others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) of all rows, and the binary columns ``others``; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([simhash(t or b"", k) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), *(batch.column(c) for c in others)], names=["doc_id", "fp", *others])

    schema = ", ".join(["doc_id long, fp long", *(f"{c} binary" for c in others)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *others).mapInArrow(run, schema)


# --- comparison within a bucket ------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """Plane p, word w, bit j: bit p of fingerprint 64 w + j."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, 64), dtype=np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, candidates: np.ndarray, radius: int = RADIUS, after: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of indexes whose fingerprints differ in ``radius`` (4 at most) or fewer bits; ``after``: only j > i."""
    vertical, words = planes(candidates), -(-len(candidates) // 64)
    step = max(1, LIVE // max(words, 1))
    full = np.uint64(2**64 - 1)
    for at in range(0, len(queries), step):
        own_queries = queries[at : at + step]
        q, w = np.divmod(np.arange(len(own_queries) * words), words)
        if after:
            keep = w * 64 + 63 > q + at
            q, w = q[keep], w[keep]
        ones = np.zeros(len(q), dtype=np.uint64)
        twos, fours, dead = ones.copy(), ones.copy(), ones.copy()
        for p in range(0, 64, 4):
            a, b, c, d = (vertical[p + i][w] ^ (-((own_queries[q] >> np.uint64(p + i)) & np.uint64(1))) for i in range(4))
            x = ones ^ a
            carry, ones = ones & a | x & b, x ^ b
            x = ones ^ c
            carry2, ones = ones & c | x & d, x ^ d
            x = twos ^ carry
            carry4, twos = twos & carry | x & carry2, x ^ carry2
            dead |= fours & carry4
            fours |= carry4
            over = dead | exceeds(ones, twos, fours, radius)
            live = over != full
            if not live.all():
                q, w, ones, twos, fours, dead = q[live], w[live], ones[live], twos[live], fours[live], dead[live]
            if not len(q):
                break
        if len(q):
            near = ~(dead | exceeds(ones, twos, fours, radius))
            some = np.flatnonzero(near)
            # Where all are close to all, each block gives 64 pairs, so few blocks are spelled out at once.
            for first in range(0, len(some), SPELLED):
                own = some[first : first + SPELLED]
                block, bit = np.nonzero(np.unpackbits(near[own].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                i, j = q[own][block] + at, w[own][block] * 64 + bit
                keep = (j < len(candidates)) & ((j > i) if after else True)
                yield i[keep], j[keep]


def exceeds(ones, twos, fours, radius: int):
    """Mask of the counters over ``radius``."""
    return {
        0: lambda: ones | twos | fours,
        1: lambda: twos | fours,
        2: lambda: ones & twos | fours,
        3: lambda: fours,
        4: lambda: fours & (ones | twos),
    }[radius]()


# --- on Spark ------------------------------------------------------------------------------


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The fewest blocks whose tables have buckets of BUCKET or fewer fingerprints, were these spread evenly."""
    for blocks in range(radius + 1, radius + 5):
        if n >> (64 // blocks * (blocks - radius)) <= BUCKET:
            return blocks
    return radius + 4


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bits of each combination of ``blocks - radius`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(own, blocks - radius)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _bucket_links(radius: int):
    def of(key: tuple, fps: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links between the fingerprints of two tiles, or within one."""
        forest = Forest(len(fps))
        first = np.flatnonzero(tile == tile.min())
        rest = np.flatnonzero(tile != tile.min())
        if len(rest):
            for i, j in within(fps[first], fps[rest], radius):
                forest.link(first[i], rest[j])
        else:
            for i, j in within(fps, fps, radius, after=True):
                forest.link(i, j)
        member, root = forest.edges()
        return fps[member], fps[root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, columns in runs(batches, ["t", "key", "pair"]):
            if len(columns["fp"]) > 1:
                a, b = of(key, columns["fp"].view(np.uint64), columns["tile"])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """The runs of equal keys of sorted rows, one in memory at a time."""
    held: list[dict[str, np.ndarray]] = []

    def flush():
        whole = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
        return tuple(int(whole[k][0]) for k in keys), whole

    for batch in batches:
        columns = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts, starts[1:], strict=False):
            part = {c: v[a:b] for c, v in columns.items()}
            if held and any(held[0][k][0] != part[k][0] for k in keys):
                yield flush()
                held = []
            held.append(part)
    if held:
        yield flush()


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect whatever is connected among the fingerprints ``distinct`` (fp)."""
    spark = distinct.sparkSession
    blocks = blocks or blocks_for(distinct.count(), radius)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(blocks, radius))]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    # A bucket over TILE is cut into tiles, and each pair of tiles is a bucket of its own.
    tiles = F.ceil(F.coalesce("n", F.lit(1)) / TILE).cast("int")
    rows = rows.join(large, ["t", "key"], "left").withColumn("tiles", tiles)
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.least(x, F.col("tile")) * F.col("tiles") + F.greatest(x, F.col("tile")))
    rows = rows.select("t", "key", F.explode(pairs).alias("pair"), "tile", "fp")
    return rows.repartition(n, "t", "key", "pair").sortWithinPartitions("t", "key", "pair").mapInArrow(_bucket_links(radius), "a long, b long")


def grouped(rows: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(fp, first, n, component) of the distinct fingerprints of ``rows`` (doc_id, fp): the smallest id, how many rows, and the component's smallest fingerprint."""
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct.select("fp"), radius, blocks))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = WORDS, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of all rows of ``docs`` (doc_id, text)."""
    rows = staged(fingerprints(docs, k), "fingerprints")
    members = staged(grouped(rows, radius, blocks), "members")
    names = staged(members.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "names")
    named = staged(spread_join(members.withColumnRenamed("n", "rows"), names, ["component"]).select("fp", F.col("rows").alias("n"), "component_id"), "named")
    return spread_join(rows, named, ["fp"]).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, k: int = WORDS) -> DataFrame:
    """One document of each component, and one of its documents without an id, if it has any.

    It is the one with the smallest id; of equal ids, the one whose text hashes lowest; of equal texts, the one whose
    other columns, as JSON, do. Rows that are equal in all columns are one document.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    own = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b"|"), text), 256))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # A null text and an empty one tie too.
    others = F.sha2(F.to_json(F.struct(F.col("text").isNull().alias("__null"), *rest)), 256)
    docs = docs.withColumn("__row", F.concat(own, F.unhex(others)))
    rows = staged(fingerprints(docs, k, ("__row",)), "fingerprints")
    members = staged(grouped(rows, radius), "members")
    least = lambda of: F.min(of).alias("least")
    # By fingerprint first, so a component with many rows is a few when it meets.
    by_fp = rows.groupBy("fp", F.col("doc_id").isNull().alias("lone")).agg(least(F.struct("doc_id", "__row")))
    by_component = by_fp.join(members.select("fp", "component"), "fp").groupBy("component", "lone").agg(least("least"))
    kept = staged(by_component.select("least.__row"), "kept")
    # Rows that very many rows equal, in every column, are one in each task before they meet; such rows are few.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max((members.agg(F.sum("n")).first()[0] or 0) // (4 * parts), 16)
    often = rows.join(F.broadcast(members.where(F.col("n") > each).select("fp")), "fp", "left_semi").groupBy("__row").agg(F.count("*").alias("n"))
    hot = staged(often.where(F.col("n") > each).select("__row"), "hot")
    found = docs.join(F.broadcast(hot), "__row", "left_anti").join(kept, "__row", "left_semi")
    if not hot.isEmpty():
        found = found.unionByName(docs.join(F.broadcast(hot.join(kept, "__row", "left_semi")), "__row", "left_semi").dropDuplicates(["__row"]))
    return found.dropDuplicates(["__row"]).drop("__row")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
