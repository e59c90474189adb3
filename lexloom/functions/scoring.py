"""Scores, labels, confidence, intervals and percentiles as Column expressions over ``pct_<category>`` columns."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import weights as w


def pct(category: str) -> Column:
    return F.col(f"pct_{category}")


def round2(x: Column) -> Column:
    """To two digits, half away from zero on the binary product."""
    return F.round(x * 100) / 100


def clamp(x: Column) -> Column:
    """Into [0, 1], to two digits."""
    return F.when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(round2(x))


# Scores of fixed models are one SQL text each: a plan of them takes a call a score, and not one for each term and operator.


def linear(terms: tuple[tuple[str, float], ...], start: float = w.START) -> Column:
    x = " + ".join([f"{start!r}D", *(f"{weight!r}D * `pct_{category}`" for category, weight in terms)])
    return F.expr(f"CASE WHEN {x} < 0 THEN 0D WHEN {x} > 1 THEN 1D ELSE round(({x}) * 100) / 100 END")


def trait(name: str) -> Column:
    return linear(w.TRAITS[name])


def summary(name: str) -> Column:
    """A sigmoid of the difference of percents, to two digits."""
    plus, minus, divisor = w.SUMMARY[name]
    x = " + ".join(f"`pct_{c}`" for c in plus) + "".join(f" - `pct_{c}`" for c in minus)
    return F.expr(f"round((1D / (1D + exp(-(({x}) / {float(divisor)!r}D)))) * 100) / 100")


def confidence_flag(n: Column, coverage: Column) -> Column:
    return F.when(n < 500, "low").when((coverage < 0.6) | (n < 1000), "medium").otherwise("high")


def ci_width(n: Column, coverage: Column) -> Column:
    """Half the width of a 95 % interval; without words the widest."""
    width = F.lit(1.96) * (F.lit(0.08) / F.sqrt(F.nullif(n.cast("double"), F.lit(0.0)) / F.lit(1000.0)))
    width = width * F.when(coverage < 0.5, F.lit(1.5)).when(coverage < 0.7, F.lit(1.2)).otherwise(F.lit(1.0))
    return round2(F.least(F.greatest(F.coalesce(width, F.lit(0.25)), F.lit(0.02)), F.lit(0.25)))


#: The least score of each percentile from 2 to 99, of a normal distribution with mean 0.5 and deviation 0.12.
PERCENTILES = [0.5 + 0.12 * NormalDist().inv_cdf((k - 0.5) / 100) for k in range(2, 100)]


#: How many of these are at or below 0.00, 0.01, ... 0.99; at most NEAR are within the next two hundredths.
BELOW, NEAR = [sum(p <= h / 100 for p in PERCENTILES) for h in range(100)], 10


def percentile(score: Column) -> Column:
    """One more than the least scores at or below ``score``; only those near it are compared."""
    bounds = F.expr(f"array({', '.join(f'{p!r}D' for p in PERCENTILES)})")
    below = F.expr(f"array({', '.join(map(str, BELOW))})")[F.greatest(F.least(F.floor(score * 100) - 1, F.lit(99)), F.lit(0)).cast("int")]
    return F.lit(1) + below + F.size(F.filter(F.slice(bounds, below + 1, F.lit(NEAR)), lambda p: p <= score))


def low_end(score: Column, width: Column) -> Column:
    return round2(F.greatest(F.lit(0.0), score - width))


def high_end(score: Column, width: Column) -> Column:
    return round2(F.least(F.lit(1.0), score + width))


def trait_label(name: str, score: Column) -> Column:
    high, low, middle, closed = w.TRAIT_LABELS[name]
    return F.when(score >= w.HIGH if closed else score > w.HIGH, high).when(score < w.LOW, low).otherwise(middle)


def summary_label(name: str, score: Column) -> Column:
    _, high, low, middle = w.SUMMARY_LABELS[name]
    return F.when(score >= w.HIGH, high).when(score < w.LOW, low).otherwise(middle)
