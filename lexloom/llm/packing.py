"""Packing of documents into sequences of a fixed number of tokens.

Only the histogram of piece lengths (as many bins as a sequence has tokens) reaches the
driver. There, patterns of two or three lengths that fill a sequence are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded down, and
what is left is packed best-fit, longest first, still by length and not by document. The plan
says, for each length, which ranks go to which sequence and offset. Ranks are given on Spark:
within a length, documents are dealt to hashed buckets, numbered there, and moved on by the
buckets before, so a length that very many documents share has no task of its own.

Cases: a null text is the empty text, whose one piece is the separator; null ids and repeated
rows are packed like any other, a repeated row once for each time; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import slices, staged, table
from lexloom.llm.tokens import ByteBpe

CAPACITY, SEPARATOR = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- pieces --------------------------------------------------------------------------------


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all but the first have ``capacity`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; ``with_ids`` adds the ids as little-endian 32-bit bytes."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBpe(vocabulary), SEPARATOR.to_bytes(4, "little")
        for batch in slices(batches):
            rows, number, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                data = bpe.ids(text or "") + end
                for k, (at, n) in enumerate(cuts(len(data) // 4, capacity)):
                    own = data[4 * at : 4 * (at + n)]
                    rows.append(row), number.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(own)
            out = {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "piece": pa.array(number, pa.int32())}
            out |= {"start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# --- the plan, from the histogram alone ----------------------------------------------------


def patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """All patterns of two or three of the lengths ``present`` (a mask by length) that fill a sequence; 0 is no document."""
    found = []
    for a in np.flatnonzero(present):
        b = np.arange(a, (capacity - a) // 2 + 1)
        c = capacity - a - b
        keep = present[b] & present[c] & (c >= b)
        found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], axis=1))
        if capacity - a >= a and present[capacity - a]:
            found.append(np.array([[0, a, capacity - a]]))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def non_negative_least_squares(columns: np.ndarray, counts: np.ndarray, rounds: int = 60, added: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Minimises |A x - counts| over x >= 0, column j of A having a 1 at each of ``columns[j]``.

    An active-set method: columns with the largest gradient join, no two of a round with a
    length in common; the least squares over the active ones are solved by conjugate gradients;
    steps stop where a count would turn negative, and that column leaves. Returns the active
    columns and their x; there are about as many as lengths, so few counts are lost by rounding.
    """
    weight = np.ones(len(counts))
    weight[0] = 0
    target = counts * weight

    def forward(cols, x):
        return np.bincount(cols.ravel(), weights=np.repeat(x, 3), minlength=len(counts)) * weight

    def solve(cols, x):
        r = (target - forward(cols, x))[cols].sum(1)
        p, rr = r.copy(), float(r @ r)
        for _ in range(80):
            if rr < 1e-6:
                break
            q = forward(cols, p)[cols].sum(1)
            step = rr / max(float(p @ q), 1e-12)
            x, r = x + step * p, r - step * q
            rr, old = float(r @ r), rr
            p = r + (rr / old) * p
        return x

    active, x = np.zeros(0, dtype=np.int64), np.zeros(0)
    for _ in range(rounds):
        residual = target - forward(columns[active], x)
        gain = residual[columns].sum(1)
        gain[active] = -np.inf
        best = np.argsort(-gain)[: added * 16] if len(gain) <= added * 16 else (top := np.argpartition(-gain, added * 16)[: added * 16])[np.argsort(-gain[top])]
        used, chosen = set(), []
        for j in best:
            own = set(columns[j].tolist()) - {0}
            if gain[j] <= 1 or len(chosen) == added:
                break
            if not own & used:
                used |= own
                chosen.append(j)
        if not chosen:
            break
        active, x = np.concatenate([active, chosen]), np.concatenate([x, np.zeros(len(chosen))])
        while len(active):
            new = solve(columns[active], x)
            if (new >= 0).all():
                x = new
                break
            falling = (new < 0) & (x > new)
            x = np.maximum(x + np.min(x[falling] / (x - new)[falling], initial=1.0) * (new - x), 0)
            keep = ~(falling & (x <= 1e-9)) if (falling & (x <= 1e-9)).any() else x > np.min(x[falling])
            active, x = active[keep], x[keep]
    return columns[active], x


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths of a sequence, how many such sequences)."""
    open_, spaces = defaultdict(list), []  # by free space

    def put(space: int, content: tuple[int, ...], n: int) -> None:
        if space not in open_ or not open_[space]:
            bisect.insort(spaces, space)
        open_[space].append((content, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(spaces, length)
            if k == len(spaces):
                content, n, space = (), -(-left // (capacity // length)), capacity
            else:
                space = spaces[k]
                content, n = open_[space].pop()
                if not open_[space]:
                    spaces.pop(k)
            each = min(space // length if not content else 1, left)
            taken = min(n, left // each)
            if taken < n and content:
                put(space, content, n - taken)
            put(space - each * length, content + (length,) * each, taken)
            left -= taken * each
    return [x for own in open_.values() for x in own]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences; together they use each length as often as ``counts`` says."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    columns = patterns(capacity, left[:capacity] > 0) if left.sum() else np.zeros((0, 3), dtype=np.int64)
    if len(columns):
        chosen, x = non_negative_least_squares(columns, left.astype(float))
        for j in np.argsort(-x):
            own, times = np.unique(chosen[j][chosen[j] > 0], return_counts=True)
            n = int(min(np.floor(x[j]), (left[own] // times).min()))
            if n > 0:
                left[own] -= n * times
                out.append((tuple(int(v) for v in chosen[j] if v), n))
    return out + best_fit({int(k): int(left[k]) for k in np.flatnonzero(left)}, capacity)


def intervals(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) by length and rank: a rank r of the length goes to sequence first + r - first rank."""
    rows, used, base = [], defaultdict(int), 0
    for lengths, n in sequences:
        at = 0
        for length in lengths:
            rows.append((length, used[length], base, at))
            used[length] += n
            at += length
        base += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


# --- on Spark ------------------------------------------------------------------------------


def ranked(found: DataFrame, buckets: int) -> DataFrame:
    """``found`` with ``rank``, from 0 within each length."""
    rows = found.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))  # ids may be null, or shared
    before = W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    offsets = offsets.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    number = F.row_number().over(W.partitionBy("length", "__bucket").orderBy("doc_id", "piece"))
    return rows.withColumn("__number", number).join(offsets, ["length", "__bucket"]).withColumn("rank", F.col("__before") + F.col("__number") - 1).drop("__bucket", "__before", "__number")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence_id and offset."""
    found = staged(pieces(docs, capacity, vocabulary, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    by_rank = intervals(plan(counts, capacity))
    keys = by_rank[:, 0] * 2**44 + by_rank[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in ("rank", "length"))
            own = by_rank[np.searchsorted(keys, length * 2**44 + rank, side="right") - 1]
            columns = [batch.column(c) for c in names] + [pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = found.columns
    schema = PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked(found, buckets).mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of :func:`pack` ``with_ids``: the ids of each sequence in order, a few pieces each."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(own, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents and their places."""
    return pack(table(spark, sf_dir, "documents"))
