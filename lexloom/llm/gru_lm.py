"""Scores by a gated recurrent language model.

Words are counted on Spark over all training documents. The most frequent ones are symbols of the
network; other words fall, by their last two bytes, into buckets that are symbols too, and are
drawn within a bucket by their smoothed counts, so every word has a probability and those of all
words sum to one. The network (a GRU in numpy, output softmax factored into classes and words of
a class) is trained by truncated backpropagation, the state carried from window to window and
cleared at a document's end. It starts from a bounded sample; then every training document is seen
once, in ROUNDS rounds: its documents are dealt by hashes to copies of the network, one for
COPY_TOKENS tokens but MOST_COPIES at most, whatever the input, and the copies are averaged by their tokens in a tree. How the table is split
changes none of this, so scores follow from the table's rows, but for the last digits of sums. For
scoring, whole documents are laid into parallel streams, so each is read from its first word to its end
with its own state.

Texts are read twice: to count words, and to stage each document's symbols, which training and
scoring read. Counts of the HEAD most frequent words go to every task; rarer words are joined with
their counts on Spark.

Cases: a null text is the empty text, whose only token is the end; documents without an id count as
training documents; repeated rows each get a result; without training documents N and V are 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import lowest_hashes, slices, staged, table

FOLDS, HELD_OUT = 7, 2
#: Words whose counts every task holds, at most.
HEAD = 131_072
#: Symbols: classes, words a class, buckets of other words; width of the state.
CLASSES, IN_CLASS, BUCKETS, WIDTH = 24, 32, 64, 16
SYMBOLS = CLASSES * IN_CLASS
#: Symbol 0 is the end; then the most frequent words; the last BUCKETS are the buckets.
WORDS = SYMBOLS - BUCKETS - 1
#: Training: documents and tokens of the first sample at most and passes over it, rounds over all, streams, steps back, rate.
FIRST_DOCUMENTS, FIRST_TOKENS, FIRST_PASSES, ROUNDS, STREAMS, BACK, RATE = 512, 1 << 20, 4, 2, 512, 12, 0.004
#: Tokens of a round that one copy of the network is trained on, about; tokens that it lays out at once.
COPY_TOKENS, HELD_TOKENS = 1 << 20, 1 << 22
#: Copies of the network in a round at most: beyond, each is trained on more tokens, of which it lays out HELD_TOKENS at once.
MOST_COPIES = 2048
#: Scoring: streams, steps whose outputs are computed at once, steps laid out at once (a multiple of SPAN).
LANES, SPAN, LAID = 512, 32, 512
#: Documents that are scored together at most: of fewer, the longest would leave most streams empty for most steps.
SCORED = 8192
END = b""


# --- network -------------------------------------------------------------------------------


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "embedding": draw(SYMBOLS, WIDTH),
        "input": draw(WIDTH, 3 * WIDTH),
        "state": draw(WIDTH, 3 * WIDTH),
        "bias": np.zeros(3 * WIDTH, np.float32),
        "classes": draw(WIDTH, CLASSES),
        "classes_bias": np.zeros(CLASSES, np.float32),
        "words": draw(CLASSES, WIDTH, IN_CLASS),
        "words_bias": np.zeros((CLASSES, IN_CLASS), np.float32),
    }


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in params.values()])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in initial().items():
        out[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


class Room:
    """Arrays of rows by name that are used again, for fresh large ones cost a page fault for each 4 KB."""

    def __init__(self):
        self.flat: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: int, columns: int) -> np.ndarray:
        size = rows * columns
        if name not in self.flat or len(self.flat[name]) < size:
            self.flat[name] = np.empty(size, np.float32)
        return self.flat[name][:size].reshape(rows, columns)


def step(gates: np.ndarray, h: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state; ``gates``: the input's part. Fastest where the values of a feature, a column, lie together."""
    gates, h = gates.T, h.T
    own = state.T @ h
    zr = gates[: 2 * WIDTH] + own[: 2 * WIDTH]
    zr *= 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    z, r = zr[:WIDTH], zr[WIDTH:]
    n = r * own[2 * WIDTH :]
    n += gates[2 * WIDTH :]
    np.tanh(n, out=n)
    after = h - n
    after *= z
    after += n
    return after.T, z.T, r.T, n.T, own[2 * WIDTH :].T


def _softmax(x: np.ndarray, divided: bool) -> np.ndarray:
    """Makes exponentials of ``x``, in place, or, ``divided``, probabilities by column; the logarithms of the columns' sums."""
    if x.max(initial=0) > 60:  # far beyond trained values
        np.minimum(x, 60, out=x)  # keeps the exponentials finite
    np.exp(x, out=x)
    total = x.sum(axis=0)
    if divided:
        x *= 1 / total
    return np.log(total)


def outputs(params, h: np.ndarray, y: np.ndarray, grads: dict | None = None, room: Room | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The log probability of each target symbol; with ``grads`` also the gradient of their mean's negative by ``h``."""
    m, room, y = len(y), room or Room(), y.astype(np.int16, copy=False)
    order = np.argsort(y // IN_CLASS, kind="stable")  # by class, so each class is one product
    y = y[order]
    one = room("h", WIDTH + 1, m)  # with a row of ones, for what is added to a product
    one[WIDTH] = 1
    h = np.take(h.T.astype(np.float32, copy=False), order, axis=1, out=one[:WIDTH], mode="clip")
    cls, word, rows = y // IN_CLASS, y % IN_CLASS, np.arange(m)
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1, dtype=np.int16)).tolist()
    slices = [(c, slice(cuts[c], cuts[c + 1])) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]
    by_class, by_word = room("by_class", CLASSES, m), room("by_word", IN_CLASS, m)
    np.matmul(np.concatenate([params["classes"], params["classes_bias"][None]]).T, one, out=by_class)
    words = np.concatenate([params["words"], params["words_bias"][:, None]], axis=1)
    for c, own in slices:
        np.matmul(words[c].T, one[:, own], out=by_word[:, own])
    at_class, at_word = (x.astype(np.int64) * m + rows for x in (cls, word))
    flat_class, flat_word = room.flat["by_class"], room.flat["by_word"]
    picked = flat_class[at_class] + flat_word[at_word]
    picked -= _softmax(by_class, grads is not None) + _softmax(by_word, grads is not None)
    log_p = np.empty(m)
    log_p[order] = picked
    if grads is None:
        return log_p, None
    flat_class[at_class] -= 1
    flat_word[at_word] -= 1
    one /= m
    d_classes, d_words = one @ by_class.T, np.zeros_like(words)
    by_h = np.matmul(params["classes"], by_class, out=room("by_h", WIDTH, m))
    for c, own in slices:
        np.matmul(one[:, own], by_word[:, own].T, out=d_words[c])
        by_h[:, own] += params["words"][c] @ by_word[:, own]
    by_h /= m
    grads["classes"], grads["classes_bias"], grads["words"], grads["words_bias"] = d_classes[:WIDTH], d_classes[WIDTH], d_words[:, :WIDTH], d_words[:, WIDTH]
    back = np.empty_like(order)
    back[order] = rows
    return log_p, np.take(by_h, back, axis=1, out=room("dh", WIDTH, m), mode="clip").T


def window(params, x: np.ndarray, y: np.ndarray, h: np.ndarray, room: Room | None = None) -> tuple[dict, np.ndarray, float]:
    """Gradients over one window (``x``, ``y``: steps by streams), the state after it, and the mean log probability."""
    (steps, streams), room, x = x.shape, room or Room(), x.astype(np.int16).ravel()
    by_symbol = np.ascontiguousarray((params["embedding"] @ params["input"] + params["bias"]).T, np.float32)
    # All arrays have features, steps, streams, so what one operation reads lies together.
    gates = np.take(by_symbol, x, axis=1, out=room("gates", 3 * WIDTH, x.size), mode="clip").reshape(3 * WIDTH, steps, streams)
    keep = (x != 0).astype(np.float32).reshape(steps, streams)
    before, z, r, n, own_n, after, rest, d_own = (room(k, WIDTH, x.size).reshape(WIDTH, steps, streams) for k in ("before", "z", "r", "n", "own_n", "after", "rest", "d_own"))
    h = h.T
    for t in range(steps):
        np.multiply(h, keep[t], out=before[:, t])
        for to, value in zip((after, z, r, n, own_n), step(gates[:, t].T, before[:, t].T, params["state"]), strict=True):
            to[:, t] = value.T
        h = after[:, t]
    grads: dict[str, np.ndarray] = {}
    log_p, dout = outputs(params, after.reshape(WIDTH, -1).T, y.ravel(), grads, room)
    dout, dh = dout.T.reshape(after.shape), np.zeros((WIDTH, streams), np.float32)
    d_gates = room("d_gates", 3 * WIDTH, x.size).reshape(3, WIDTH, steps, streams)  # what the gradient by the state is multiplied by, then the gradients
    dz, dr, dn = d_gates
    np.subtract(1, z, out=rest)
    np.subtract(before, n, out=dz)
    dz *= z
    dz *= rest
    np.multiply(n, n, out=dn)
    np.subtract(1, dn, out=dn)
    dn *= rest
    np.subtract(1, r, out=dr)
    dr *= r
    dr *= own_n
    dr *= dn
    both = d_gates.reshape(3 * WIDTH, steps, streams)[: 2 * WIDTH]
    for t in range(steps - 1, -1, -1):
        dh += dout[:, t]
        d_gates[:, :, t] *= dh
        np.multiply(dn[:, t], r[:, t], out=d_own[:, t])
        dh *= z[:, t]
        dh += params["state"][:, : 2 * WIDTH] @ both[:, t]
        dh += params["state"][:, 2 * WIDTH :] @ d_own[:, t]
        dh *= keep[t]
    states = before.reshape(WIDTH, -1)
    grads["state"] = np.concatenate([states @ both.reshape(2 * WIDTH, -1).T, states @ d_own.reshape(WIDTH, -1).T], axis=1)
    order = np.argsort(x, kind="stable")
    symbols = x[order]
    starts = np.flatnonzero(np.diff(symbols, prepend=-1))
    d_symbol = np.zeros((SYMBOLS, 3 * WIDTH), np.float32)
    ordered = np.take(d_gates.reshape(3 * WIDTH, -1), order, axis=1, out=room("ordered", 3 * WIDTH, x.size), mode="clip")
    d_symbol[symbols[starts]] = np.add.reduceat(ordered, starts, axis=1).T
    grads["embedding"], grads["input"], grads["bias"] = d_symbol @ params["input"].T, params["embedding"].T @ d_symbol, d_symbol.sum(axis=0)
    return grads, h.copy().T, float(log_p.mean())


class Trainer:
    """Adam over windows of a stream of symbols."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = RATE):
        self.params = {k: v.copy() for k, v in params.items()}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
        self.rate, self.steps, self.room = rate, 0, Room()

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        norm = math.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-12))
        rate = self.rate * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, p in self.params.items():
            g, a, b = grads[k] * scale, self.first[k], self.second[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * a / (np.sqrt(b) + 1e-8)

    def learn(self, symbols: np.ndarray) -> float:
        """One pass over documents, each ended by symbol 0; the mean log probability."""
        streams = int(min(max(len(symbols) // (64 * BACK), 8), STREAMS, len(symbols)))  # 64 windows or more, where there are so many words
        if not streams:
            return 0.0
        length = -(-len(symbols) // streams)
        symbols = np.concatenate([symbols, symbols[: streams * length - len(symbols)]])  # the last stream is filled up from the start
        y = symbols.reshape(streams, length).T
        x = np.concatenate([np.zeros(1, symbols.dtype), symbols[:-1]]).reshape(streams, length).T
        h, total = np.zeros((streams, WIDTH), np.float32), 0.0
        for at in range(0, length, BACK):
            grads, h, mean = window(self.params, x[at : at + BACK], y[at : at + BACK], h, self.room)
            self.update(grads)
            total += mean * len(y[at : at + BACK])
        return total / length


def log_likelihoods(params, documents: list[np.ndarray]) -> np.ndarray:
    """The natural log probability of each document, an array of symbols that ends with 0."""
    out = np.zeros(len(documents))
    lengths = np.array([len(d) for d in documents])
    lanes: list[list[int]] = [[] for _ in range(min(LANES, len(documents)))]
    loads = np.zeros(len(lanes), dtype=np.int64)
    for d in np.argsort(-lengths, kind="stable").tolist():  # the longest first, to the least loaded lane
        lane = int(loads.argmin())
        lanes[lane].append(d)
        loads[lane] += lengths[d]
    order = np.argsort(-loads, kind="stable")
    loads = loads[order]
    by_symbol = np.ascontiguousarray((params["embedding"] @ params["input"] + params["bias"]).T)
    symbols = [np.concatenate([documents[d] for d in lanes[lane]]) for lane in order.tolist()]
    owners = [np.repeat(np.array(lanes[lane], dtype=np.int32), lengths[lanes[lane]]) for lane in order.tolist()]
    h, room = np.zeros((WIDTH, len(lanes)), np.float32), Room()
    longest = int(loads.max(initial=0))
    for at in range(0, longest, SPAN):
        stop = min(at + SPAN, longest)
        live = np.searchsorted(-loads, -np.arange(at, stop), side="left").tolist()  # lanes longer than t
        if at % LAID == 0:  # only so many steps of the live lanes are laid out, so one long document doesn't widen all lanes
            x, y, of = laid(symbols[: live[0]], owners[: live[0]], at, min(at + LAID, longest))
        own = at % LAID
        before, targets, owner = (np.concatenate([a[t, :n] for t, n in enumerate(live, own)]) for a in (x, y, of))
        gates = np.take(by_symbol, before, axis=1, out=room("gates", 3 * WIDTH, len(before)), mode="clip")
        keep, states, first = (before != 0).astype(np.float32), room("states", WIDTH, len(before)), 0
        for n in live:
            last = first + n
            h = step(gates[:, first:last].T, (h[:, :n] * keep[first:last]).T, params["state"])[0].T
            states[:, first:last] = h
            first = last
        log_p, _ = outputs(params, states.T, targets, room=room)
        out += np.bincount(owner, weights=log_p, minlength=len(out))
    return out


def laid(symbols: list[np.ndarray], owners: list[np.ndarray], at: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps ``at`` to ``stop`` of lanes, steps by lanes: the symbols before, the symbols, and their documents."""
    x, y = (np.zeros((stop - at, len(symbols)), dtype=np.int16) for _ in range(2))
    of = np.zeros(y.shape, dtype=np.int32)
    for k, (lane, owner) in enumerate(zip(symbols, owners, strict=True)):
        part = lane[at:stop]
        y[: len(part), k] = part
        of[: len(part), k] = owner[at:stop]
        if at:
            x[0, k] = lane[at - 1]
    x[1:] = y[:-1]
    return x, y, of


# --- words ---------------------------------------------------------------------------------


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: A-Z only, and \x20 \x09-\x0d


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


class Vocabulary:
    """Counts of the head, the symbols, and the totals of the buckets."""

    def __init__(self, head: list[tuple[bytes, int]], tokens: int, distinct: int, buckets: dict[int, tuple[int, int]]):
        """``head``: words by falling count; ``buckets``: tokens and distinct words of those that are no symbols."""
        self.tokens, self.distinct, self.buckets = tokens, distinct, buckets
        self.documents = dict(head).get(END, 0)
        self.place = {w: i for i, (w, _) in enumerate(head)}
        names = [w for w, _ in head if w != END][:WORDS]
        symbol = {w: i + 1 for i, w in enumerate(names)} | {END: 0}
        self.symbol = np.array([symbol.get(w, SYMBOLS - BUCKETS + bucket_of(w)) for w, _ in head], dtype=np.int16)
        counts = np.array([c for _, c in head], dtype=np.float64)
        self.base = np.log10((counts + 1) / (tokens + distinct + 1))
        within = np.array([0.0 if w in symbol else self.bucket_total(bucket_of(w)) for w, _ in head])
        self.within = np.where(within > 0, np.log10((counts + 1) / np.maximum(within, 1)), 0.0)

    def bucket_total(self, bucket: int) -> float:
        n, v = self.buckets.get(bucket, (0, 0))
        return float(n + v + 1)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols with the end, places in the head (-1: not there), and the words that aren't there."""
        get = self.place.get
        at = np.fromiter(map(get, chain(words, (END,)), repeat(-1)), np.int64, len(words) + 1)
        own = self.symbol[at] if len(self.symbol) else np.zeros(len(at), dtype=np.int16)
        missing = np.flatnonzero(at[:-1] < 0)
        tail = [words[i] for i in missing.tolist()]
        own[missing] = [SYMBOLS - BUCKETS + bucket_of(w) for w in tail]
        own[-1] = 0
        return own, at, tail


# --- on Spark ------------------------------------------------------------------------------


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over ``docs`` (text in binary); the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        held: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                held.update(words_of(text))
                held[END] += 1
                if len(held) > 200_000:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the table of all words' counts: two sums, HEAD rows and BUCKETS rows reach the driver."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The least count of the head, by a histogram of counts in 64 steps a doubling: sorting would send HEAD rows a partition.
    steps = F.floor(F.log2("c") * 64).cast("int")
    sizes = {r["s"]: r["n"] for r in counts.groupBy(steps.alias("s")).agg(F.count("*").alias("n")).collect()}
    least, room = 1 << 30, HEAD
    for s in sorted(sizes, reverse=True):
        if (room := room - sizes[s]) < 0:
            break
        least = s
    head = [(bytes(r["word"]), r["c"]) for r in counts.where((steps >= least) | (F.octet_length("word") == 0)).collect()]
    head.sort(key=lambda x: (-x[1], x[0]))
    named = [w for w, _ in head if w != END][:WORDS] + [END]
    names = F.broadcast(counts.sparkSession.createDataFrame([(bytearray(w),) for w in named], "word binary"))
    bucket = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(BUCKETS)).cast("int")
    rest = counts.join(names, "word", "left_anti").groupBy(bucket.alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    return Vocabulary(head, tokens, distinct, {r["b"]: (r["n"], r["v"]) for r in rest})


def _learner(start, rate: float, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen, own, size = Trainer(start.value, rate), 0, [], 0
        for document in (d for batch in slices(batches) for d in documents_of(batch)):
            if passes > 1 and seen + size + len(document) > FIRST_TOKENS and size:
                break  # the first sample ends here
            own.append(document)
            size += len(document)
            if size >= HELD_TOKENS and passes == 1:
                trainer.learn(np.concatenate(own))
                seen, own, size = seen + size, [], 0
        if own:
            symbols = np.concatenate(own)
            for _ in range(passes):
                trainer.learn(symbols)
            seen += size
        if seen:
            yield pa.RecordBatch.from_pydict({"n": [seen], "params": [flat(trainer.params).astype("<f4").tobytes()]})

    return run


def documents_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The symbols of each row."""
    return [np.frombuffer(x, "<i2") for x in batch.column("symbols").to_pylist()]


def of_tokens(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of 2 * HELD_TOKENS symbols at most, or of one row."""
    first, size = 0, 0
    for row, n in enumerate(pc.binary_length(batch.column("symbols")).to_pylist()):
        if row > first and size + n > 2 * HELD_TOKENS * 2:  # of two bytes
            yield batch.slice(first, row - first)
            first, size = row, 0
        size += n
    yield batch.slice(first)


def averaged(trained: DataFrame) -> dict[str, np.ndarray] | None:
    """The mean of (n, params), weighted by n, by a tree of sums."""
    one = lambda r: (float(r["n"]), r["n"] * np.frombuffer(bytes(r["params"]), "<f4").astype(np.float64))
    add = lambda a, b: b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])
    total = trained.rdd.treeAggregate(None, lambda acc, r: add(acc, one(r)), add, depth=2)
    return None if total is None else shaped(total[1] / total[0])


def train(encoded: DataFrame, vocab: Vocabulary) -> dict[str, np.ndarray]:
    """The network's weights from all training documents of ``encoded`` (doc_id, symbols)."""
    context, params = encoded.sparkSession.sparkContext, initial()
    own = encoded.where(~held_out()).select("doc_id", "symbols")
    order = [F.xxhash64(F.lit(4), "doc_id"), F.col("doc_id"), F.col("symbols")]
    first = lowest_hashes(own.select("doc_id").distinct(), FIRST_DOCUMENTS, vocab.documents)
    sample = own.join(F.broadcast(staged(first, "first")), "doc_id").groupBy("doc_id").agg(F.min("symbols").alias("symbols"))  # of rows that share an id one
    sample = sample.repartition(1).sortWithinPartitions(*order)
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(ROUNDS))
    copies = max(1, min(MOST_COPIES, -(-vocab.tokens // (ROUNDS * COPY_TOKENS))))
    copy = F.pmod(F.xxhash64(F.lit(6), "doc_id", "symbols"), F.lit(copies)).cast("int")
    dealt = lambda k: own.where(half == k).repartitionById(copies, copy).sortWithinPartitions(*order)
    plans = [(sample, RATE * 2, FIRST_PASSES)] + [(dealt(k), RATE / (k + 1), 1) for k in range(ROUNDS)]
    for k, (part, rate, passes) in enumerate(plans):
        run = _learner(context.broadcast(params), rate, passes)
        params = averaged(staged(part.select("symbols").mapInArrow(run, "n long, params binary"), f"round{k}")) or params
    return params


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per row of ``docs`` (doc_id, text in binary): its symbols, what follows from the head, and the tail's words with their buckets and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    entry = pa.struct([("word", pa.binary()), ("bucket", pa.int32()), ("k", pa.int64())])
    schema = "doc_id long, row long, n_tokens long, n_known long, base double, within double, symbols binary, tail array<struct<word: binary, bucket: int, k: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = shared.value, TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            lengths, symbols, known, base, within, offsets = [], [], [], [], [], [0]
            words, buckets, times = [], [], []
            for text in batch.column("text").to_pylist():
                found, place, tail = own.symbols(words_of(text))
                lengths.append(len(found))
                symbols.append(found.astype("<i2").tobytes())
                place = place[place >= 0]
                known.append(len(place))
                base.append(float(own.base[place].sum()))
                within.append(float(own.within[place].sum()))
                if len(place) + len(tail) < len(found):  # no training document, so no end among the counts
                    base[-1] += math.log10(1 / (own.tokens + own.distinct + 1))
                counted = Counter(tail)
                words += counted
                buckets += map(bucket_of, counted)
                times += counted.values()
                offsets.append(len(words))
            tails = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(buckets, pa.int32()), pa.array(times, pa.int64())], fields=list(entry))
            n = batch.num_rows
            columns = [batch.column("doc_id"), pa.array(np.arange(row, row + n)), pa.array(lengths, pa.int64()), pa.array(known, pa.int64())]
            columns += [pa.array(base, pa.float64()), pa.array(within, pa.float64()), pa.array(symbols, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tails)]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_tokens", "n_known", "base", "within", "symbols", "tail"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def network_scores(rows: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` (doc_id, row, n_tokens, n_known, base, within, symbols) with ``network``, the log10 probability of the symbols, instead of these."""
    weights = rows.sparkSession.sparkContext.broadcast(params)
    names = ["doc_id", "row", "n_tokens", "n_known", "base", "within"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in slices(batches, SCORED) for part in of_tokens(batch)):
            found = log_likelihoods(weights.value, documents_of(batch)) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found)], names=[*names, "network"])

    return rows.select(*names, "symbols").mapInArrow(run, "doc_id long, row long, n_tokens long, n_known long, base double, within double, network double")


def scores(docs: DataFrame) -> DataFrame:
    """The result of op6 for all rows of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    training = rows.where(~held_out())
    counts = staged(word_counts(training), "counts")
    vocab = vocabulary(counts)
    own = staged(encoded(rows, vocab), "encoded")
    parts = network_scores(own, train(own, vocab))
    tail = own.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    c = F.coalesce("c", F.lit(0))
    totals = F.array(*[F.lit(vocab.bucket_total(b)) for b in range(BUCKETS)])
    tail = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("known"),
        F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(vocab.tokens + vocab.distinct + 1)))).alias("tail_base"),
        F.sum(F.col("k") * F.log10((c + 1) / F.element_at(totals, F.col("bucket") + 1))).alias("tail_score"),
    )
    out = parts.join(tail, "row", "left")
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("network") + F.col("within") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
    )


def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all documents."""
    return scores(table(spark, sf_dir, "documents"))
