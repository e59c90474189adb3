"""Toxicity: a counterfactual-regularised classifier.

Features are the words of a text and their first four and five letters, each once. A bounded
sample of labelled documents (SAMPLE_TOXIC and SAMPLE_CLEAN, those whose ids hash lowest) gives
the features whose presence depends on the label, and a logistic regression over them. For
every labelled text with identity terms, copies with the terms swapped within their group are
made, and squared changes of the score's logit under the swap are penalised, so a group's mere
mention moves no score. The model is a few thousand weights; scoring is one pass without shuffle.

Cases: a null text is the empty text, whose score is the model's bias; label rows without a
document, with a null label or id, or a label that isn't 0 or 1 (as a number or a text), are ignored, of a document labelled twice the higher label
holds; of rows that share a labelled id the fit sees one; without labels of both kinds every score
is the share of toxic ones, or 0; documents without an id are scored and not held out; repeated
rows each get a result; an empty table gives no rows; other columns, also those named like a label,
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import lowest_hashes, slices, staged, table

#: Bounds of the sample that the classifier is fitted on, of each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Different words of a text, summed over the sample's texts, after which it holds no more texts.
SAMPLE_WORDS = 30_000_000
#: Features: how many, and the least likelihood ratio statistic (G squared) of one.
FEATURES, LEAST_G2 = 4096, 14.0
#: Weights of the squared logit changes under swaps, and of the squared weights.
SWAP_PENALTY, RIDGE, SWAPS = 1.0, 0.02, 3
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
WORD = re.compile(r"[^\W\d_]+")

#: Terms that are swapped for one another.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "lesbian", "straight", "bisexual", "heterosexual", "homosexual", "queer"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african"),
    ("immigrant", "refugee", "citizen", "foreigner", "native"),
    ("immigrants", "refugees", "citizens", "foreigners", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf", "autistic"),
)
GROUP_OF = {term: group for group in IDENTITY_GROUPS for term in group}


def words_of(text: str) -> set[str]:
    return {w for token in set(text.lower().split()) for w in WORD.findall(token)}


def features_of(words) -> set[str]:
    return {f for w in words for f in (w, w[:4] + "-", w[:5] + "--")}


def swapped(words: set[str]) -> list[set[str]]:
    """Up to SWAPS copies in which each identity term has become another of its group."""
    own = words & GROUP_OF.keys()
    out = []
    for step in range(1, SWAPS + 1) if own else ():
        to = {w: GROUP_OF[w][(GROUP_OF[w].index(w) + step) % len(GROUP_OF[w])] for w in own}
        if any(a != b for a, b in to.items()):
            out.append((words - own) | set(to.values()))
    return out


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def logit(self, text: str, cache: dict[str, tuple] | None = None) -> float:
        """``cache`` keeps the weighted features of each token."""
        cache, found = {} if cache is None else cache, set()
        for token in set(text.lower().split()):
            own = cache.get(token)
            if own is None:
                own = tuple(sorted(f for f in features_of(WORD.findall(token)) if f in self.weights))
                if len(token) <= 64:
                    cache[token] = own
            if own:
                found.update(own)
        return self.bias + math.fsum(self.weights[f] for f in found)

    def score(self, text: str, cache: dict[str, tuple] | None = None) -> float:
        z = self.logit(text, cache)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def g2(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Of a feature in a of n_a toxic and b of n_b clean texts."""
    out = np.zeros(len(a))
    for x, n in ((a, n_a), (b, n_b)):
        for part, rate in ((x, (a + b) / (n_a + n_b)), (n - x, 1 - (a + b) / (n_a + n_b))):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(part > 0, 2 * part * np.log(part / (n * rate)), 0)
    return out


class Sample:
    """Texts as sets of word numbers, each word held once."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.texts: list[np.ndarray] = []

    def add(self, words) -> None:
        self.texts.append(np.array([self.number.setdefault(w, len(self.number)) for w in sorted(words)], dtype=np.int32))

    def features(self) -> tuple[list[str], np.ndarray]:
        """Names of the features, and by word which it has."""
        names: dict[str, int] = {}
        of = np.array([[names.setdefault(f, len(names)) for f in (w, w[:4] + "-", w[:5] + "--")] for w in self.number], dtype=np.int32).reshape(-1, 3)
        return list(names), of


def fit(sample: Sample, labels: np.ndarray, weights: np.ndarray, penalty: float = SWAP_PENALTY) -> Model:
    """``weights`` of the texts undo the sampling by label."""
    n_toxic, n_clean = int((labels == 1).sum()), int((labels == 0).sum())
    if not n_toxic or not n_clean:
        share = min(max(n_toxic / max(len(labels), 1), 1e-9), 1 - 1e-9)
        return Model(math.log(share / (1 - share)))
    names, of = sample.features()
    counts = np.zeros((2, len(names)))
    for text, y in zip(sample.texts, labels, strict=True):
        counts[y, np.unique(of[text])] += 1
    stat = np.where(counts.sum(axis=0) > 1, g2(counts[1], counts[0], n_toxic, n_clean), -1)
    order = sorted(np.flatnonzero(stat >= min(LEAST_G2, np.sort(stat)[-64:][0])).tolist(), key=lambda i: (-stat[i], names[i]))[:FEATURES]
    chosen = [names[i] for n, i in enumerate(order) if stat[i] >= LEAST_G2 or n < 64 and stat[i] >= 0]
    if not chosen:
        return Model(math.log(n_toxic / n_clean))
    place = np.full(len(names), -1)
    place[order[: len(chosen)]] = np.arange(len(chosen))
    by_name = {f: i for i, f in enumerate(chosen)}

    def sparse(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([np.zeros(0, dtype=np.int64), *own])

    def of_text(text: np.ndarray) -> np.ndarray:
        own = place[np.unique(of[text])]
        return own[own >= 0]

    rows, cols = sparse([of_text(t) for t in sample.texts])
    spelled, identity = list(sample.number), np.array(sorted(sample.number[t] for t in GROUP_OF if t in sample.number), dtype=np.int32)
    pairs = [(i, s) for i, t in enumerate(sample.texts) if np.isin(t, identity).any() for s in swapped({spelled[k] for k in t})]
    swap_rows, swap_cols = sparse([np.array(sorted({by_name[f] for f in features_of(s) if f in by_name}), dtype=np.int64) for _, s in pairs])
    origin = np.array([i for i, _ in pairs], dtype=np.int64)
    y, w = labels.astype(float), weights / weights.sum()
    swap_w = w[origin] / SWAPS
    theta, bias, square = np.zeros(len(chosen)), math.log((w * y).sum() / (w * (1 - y)).sum()), np.full(len(chosen) + 1, 1e-10)
    for _ in range(400):
        z = bias + np.bincount(rows, weights=theta[cols], minlength=len(y))
        slope = w * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        change = np.bincount(swap_rows, weights=theta[swap_cols], minlength=len(pairs)) - (z[origin] - bias)
        by_row = slope - np.bincount(origin, weights=2 * penalty * swap_w * change, minlength=len(y))
        grad = np.bincount(cols, weights=by_row[rows], minlength=len(chosen)) + RIDGE * theta / len(y)
        grad += np.bincount(swap_cols, weights=(2 * penalty * swap_w * change)[swap_rows], minlength=len(chosen))
        full = np.append(grad, slope.sum())
        square += full**2
        step = 0.5 * full / np.sqrt(square)
        theta, bias = theta - step[:-1], bias - step[-1]
    return Model(float(bias), {f: float(t) for f, t in zip(chosen, theta, strict=True) if abs(t) > 1e-6})


# --- on Spark ------------------------------------------------------------------------------


def fold(column: str = "doc_id") -> Column:
    """True for held-out ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the classifier on labelled ``docs`` (doc_id, text) outside the held-out fold; ``labels`` has doc_id and toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").try_cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~fold()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bounds = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    parts = [lowest_hashes(known.where(F.col("toxic") == y), n, counts.get(y, 0)) for y, n in bounds.items()]
    sample = parts[0].unionByName(parts[1]).select("doc_id", F.col("toxic").cast("int").alias("__toxic"))
    sample = staged(sample.coalesce(1), "sample")  # 12,000 ids at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("__toxic").alias("toxic"), "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [" ".join(sorted(words_of(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.string())], names=["doc_id", "toxic", "words"])

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, toxic, held = Sample(), [], 0
        for batch in slices(batches):
            for y, own in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
                own = own.split()
                held += len(own)
                if held <= SAMPLE_WORDS:
                    sample.add(own)
                    toxic.append(y)
        labels = np.array(toxic, dtype=np.int64)
        share = {y: counts.get(y, 0) / max(toxic.count(y), 1) for y in (0, 1)}
        model = fit(sample, labels, np.array([share[y] for y in toxic]))
        yield pa.RecordBatch.from_pydict({"feature": ["", *model.weights], "weight": [model.bias, *model.weights.values()]})

    # Only the words of the sample meet in one task, and of rows that share an id those of one.
    rows = rows.mapInArrow(words, "doc_id long, toxic int, words string").groupBy("doc_id", "toxic").agg(F.min("words").alias("words"))
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    fitted = {r["feature"]: r["weight"] for r in rows.mapInArrow(collected, "feature string, weight double").collect()}
    return Model(fitted.pop("", -50.0), fitted)


def _scores(model: Model):
    cache: dict[str, tuple] = {}

    def of(texts: list[str | None]) -> list[float]:
        if len(cache) > 100_000:
            cache.clear()
        return [model.score(t or "", cache) for t in texts]

    return of


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(model)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(of(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(model)
        for batch in slices(batches):
            yield batch.filter(pa.array([s < threshold for s in of(batch.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
