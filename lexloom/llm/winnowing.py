"""Document fingerprints by winnowing.

Hashes of all k-grams of code points; of each window of ``window`` of them the smallest is
chosen, of ties the rightmost; a fingerprint is the chosen hashes with their positions. Two
texts that share ``k + window - 1`` code points in a row share a fingerprint of that passage.

Cases: a null text is the empty text, which has no hashes; a text shorter than k has one, of
all of it; the likeness of two texts without hashes is 1; in the chain of neighbours
documents without an id come last, repeated ids follow one another; the only document is its own
neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import slices, table

K, WINDOW = 16, 17
#: An odd multiplier of the rolling hash, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1), modulo 2**64."""
    own = _powers.get(base)
    if own is None or len(own) < n:
        own = np.full(max(n, 1 << 17), base, dtype=np.uint64)
        own[0] = 1
        own = _powers[base] = np.multiply.accumulate(own)
    return own[:n]


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """The hash of each k-gram, by differences of one running sum."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, n)
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, n), dtype=np.uint64)])
    h = (running[k:] - running[:-k]) * powers(BASE, n - k + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the chosen k-grams, by position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h = gram_hashes(points, k)
    if not len(h):
        return h, np.zeros(0, dtype=np.int64)
    size = min(window, len(h))
    low, at, width = h, np.arange(len(h)), 1
    while width < size:  # the minimum of `width` hashes from i on, and the rightmost place of it
        step = min(width, size - width)
        right = low[step:] <= low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return h[at], at


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint in 32 hexadecimal digits."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes() + positions.astype("<u8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of hashes: shared over all."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, positions) of every row of ``docs`` (doc_id, text), hashes as signed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [winnow(t or "", k, window) for t in batch.column("text").to_pylist()]
            columns = [pa.array([x[i].view(np.int64) for x in own], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``, or all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _by_key(of):
    """A function of keys, for arrays of them: tables of ranges are searched, and not in the expression of every row."""

    @F.pandas_udf("int")
    def run(key: pd.Series) -> pd.Series:
        return pd.Series(of(key.to_numpy()).astype(np.int32))

    return run


def neighbours(docs: DataFrame) -> DataFrame:
    """``docs`` (key, text) in ranges of falling key, each range ending with a copy (own = false) of the document that follows it.

    Texts are shuffled once. Range bounds and each range's largest key are a few numbers a
    range; a document that begins a range also goes to the range before, and the very first one to
    the last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("key")
    cuts = sorted({float(c) for c in (keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] or [])}) if n > 1 else []
    bounds = np.array([int(c) for c in cuts], dtype=np.int64)
    placed = docs.withColumn("range", _by_key(lambda key: len(bounds) - np.searchsorted(bounds, key, side="right"))("key"))  # range 0 has the largest keys
    found = placed.groupBy("range").agg(F.max("key").alias("key")).orderBy("range").collect()  # one row a range
    order, firsts = [r["range"] for r in found], np.array([r["key"] for r in found], dtype=np.int64)[::-1]  # by rising key
    # Where a range's first document goes besides: to the range before, and the very first one to the last range.
    to = np.array([*order[-1:], *order[:-1]][::-1], dtype=np.int64)

    def copy_of(key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(firsts, key), len(firsts) - 1)
        return np.where(firsts[at] == key, to[at], -1)

    own = F.struct(F.col("range"), F.lit(True).alias("own"))
    places = F.array(own)
    if len(order) > 1:
        extra = _by_key(copy_of)("key")
        places = F.when(extra < 0, places).otherwise(F.array(own, F.struct(extra.alias("range"), F.lit(False).alias("own"))))
    rows = placed.select("key", "text", F.explode(places).alias("place")).select("place.*", "key", "text")
    dealt = rows.repartitionById(max(n, 1), F.col("range"))
    return dealt.sortWithinPartitions("range", F.desc("own"), F.desc("key"), "text")


def edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """For every row of ``docs`` (doc_id, text) its fingerprint, that of its edited text, and how like it these and the next document's are."""
    lowest = -(2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = first = None

        def row(doc, following) -> tuple:
            key, text, h, at, own = doc
            other = edited(text, following[1])
            eh, eat = winnow(other, k, window)
            return (
                None if key == lowest else key, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), digest(h, at), digest(eh, eat),
                likeness(own, np.unique(eh)), likeness(own, following[4]),
            )

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in slices(batches):
            rows = []
            for own, key, text in zip(batch.column("own").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not own and before is None:
                    continue  # copies beyond the first, where an id is repeated
                h, at = winnow(text, k, window)
                doc = (key, text, h, at, np.unique(h))
                if before is not None:
                    rows.append(row(before, doc))
                first = first or doc
                before = doc if own else None
            if rows:
                yield table_of(rows)
        if before is not None:  # all documents are in one range
            yield table_of([row(before, first)])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(keyed).mapInArrow(run, schema)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its edited text and its neighbour."""
    return edits(table(spark, sf_dir, "documents"))
