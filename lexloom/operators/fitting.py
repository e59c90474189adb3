"""Trait models fitted to labels: ridge weights from a Gram matrix that Spark sums.

Each task adds up the products of its rows' features, and only these sums, one row for each pair of features, are
shuffled and reach the driver, which solves one small system. So a model of all labelled documents costs one pass.

Cases: rows with a null or non-finite feature or target are left out; a feature that never varies gets no weight beyond what the
penalty leaves; without rows the model is zero; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import scoring as S


def gram(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of ``columns``, all with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns), len(columns)))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(columns))])
            x = x[np.isfinite(x).all(axis=1)]
            total += x.T @ x
        i, j = np.triu_indices(len(columns))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    own = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    out = np.zeros((len(columns), len(columns)))
    for r in own.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def ridge(rows: DataFrame, features: list[str], target: str, penalty: float = 1.0) -> dict[str, float]:
    """The weight of each of ``features``, and of "" (the start, which isn't penalised), for ``target``."""
    g = gram(rows.withColumn("__one", F.lit(1.0)), ["__one", *features, target])
    if not g[0, 0]:
        return dict.fromkeys(["", *features], 0.0)
    a, b = g[:-1, :-1] + penalty * np.diag([0.0] + [1.0] * len(features)), g[:-1, -1]
    solved = np.linalg.solve(a, b) if penalty > 0 else np.linalg.lstsq(a, b, rcond=None)[0]
    return dict(zip(["", *features], solved.tolist(), strict=True))


def score(weights: dict[str, float]) -> Column:
    """A score in [0, 1], to two digits, as ``model`` of :func:`lexloom.operators.profile.scores` takes it."""
    return S.clamp(F.expr(" + ".join([f"{weights['']!r}D", *(f"{v!r}D * `{c}`" for c, v in weights.items() if c)])))
