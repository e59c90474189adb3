"""Profiles: scores, intervals, labels, values and summary of every document, as columns or nested."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import scoring as S
from lexloom.functions import weights as w
from lexloom.operators.features import features


def linear_model() -> dict[str, Column]:
    """The score of each trait by the fixed weights, over ``pct_<category>`` columns."""
    return {t: S.trait(t) for t in w.TRAITS}


def scores(feats: DataFrame, model: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds the nine traits and the four summary variables, the confidence flag and the interval's half width.

    ``model`` gives the traits' scores as columns of ``feats``, in [0, 1]; without it, or for traits that it lacks, they are linear.
    """
    if unknown := set(model or ()) - set(w.TRAITS):
        raise ValueError(f"not traits: {sorted(unknown)}")
    n, coverage = F.col("word_count"), F.col("coverage")
    own = linear_model() | dict(model or {}) | {s: S.summary(s) for s in w.SUMMARY}
    return feats.withColumns(own | {"confidence_flag": S.confidence_flag(n, coverage), "ci_width": S.ci_width(n, coverage)})


def trait_results(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long: one row for each document and trait."""
    each = [F.struct(F.lit(t).alias("trait"), F.col(t).alias("score"), S.trait_label(t, F.col(t)).alias("label")) for t in w.TRAITS]
    rows = scored.select(key, "ci_width", F.explode(F.array(*each)).alias("t")).select(key, "ci_width", "t.*")
    score, width = F.col("score"), F.col("ci_width")
    return rows.select(
        key, "trait", "score", S.percentile(score).cast("int").alias("percentile"), S.low_end(score, width).alias("ci_low"), S.high_end(score, width).alias("ci_high"), "label"
    )


def values_ranked(feats: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long: the ten values of each document by falling percent, ties by key."""
    each = F.array(*[F.struct((-S.pct(v)).alias("minus"), F.lit(v).alias("value"), F.lit(d).alias("display"), S.pct(v).alias("percent")) for v, d in w.VALUES.items()])
    rows = feats.select(key, F.posexplode(F.array_sort(each)).alias("at", "v"))
    return rows.select(key, F.col("v.value").alias("value"), F.col("v.display").alias("display"), F.col("v.percent").alias("percent"), (F.col("at") + 1).alias("rank"))


def trait_struct(score: Column) -> Column:
    width = F.col("ci_width")
    ends = F.array(S.low_end(score, width), S.high_end(score, width))
    return F.struct(score.alias("score"), S.percentile(score).cast("int").alias("percentile"), ends.alias("confidence_interval"))


def profiles(docs: DataFrame, lex_rows, key: str = "doc_id", analysis_id: Column | None = None, model: Mapping[str, Column] | None = None) -> DataFrame:
    """Nested: (key, analysis_id, word_count, dictionary_coverage, confidence_flag, traits, values, summary, features).

    ``analysis_id`` is a new random one, or a column such as a digest where it must not change.
    """
    own = scores(features(docs, lex_rows, key), model)
    names = [c.removeprefix("pct_") for c in own.columns if c.startswith("pct_")]
    values = lambda names, start="": F.array(*[F.col(f"`{start}{n}`") for n in names])
    pair = lambda names, own: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), own)
    return own.select(
        key,
        (F.uuid() if analysis_id is None else analysis_id).alias("analysis_id"),
        "word_count",
        F.col("coverage").alias("dictionary_coverage"),
        "confidence_flag",
        pair(list(w.TRAITS), F.transform(values(w.TRAITS), trait_struct)).alias("traits"),
        pair(list(w.VALUES), values(w.VALUES, "pct_")).alias("values"),
        F.struct(*[F.col(s) for s in w.SUMMARY]).alias("summary"),
        pair(names, values(names, "pct_")).alias("features"),
    )
