"""Running totals within keys, in an order, when one key may hold a third of all rows.

Keys with few rows are windows. The rows of a hot key are dealt out by ranges of the order: each
range is a window of its own, and what the ranges before it add up to, one row a range, is
merged into its rows. No task has all rows of a hot key, and only keys with more than the
4 * partitions-th part of the rows are hot, so there are fewer than 4 * partitions of them.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.sources.shared import staged

#: A key with fewer rows is never hot.
FEW = 1024


@dataclass(frozen=True)
class Total:
    """An associative aggregate of ``value``, and how two of its results are merged; ``before``: of earlier rows only, null where there are none."""

    value: Column
    aggregate: Callable[[Column], Column] = F.sum
    merge: Callable[[Column, Column], Column] = operator.add
    before: bool = False


def added(value: Column, before: bool = False) -> Total:
    return Total(value, before=before)


def xored(value: Column) -> Total:
    return Total(value, F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def largest(value: Column, before: bool = False) -> Total:
    return Total(value, F.max, F.greatest, before)


def running(rows: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Total], few: int = FEW) -> DataFrame:
    """``rows`` with each of ``totals`` over the rows of the same keys from the first to this one, or to the one before.

    ``rows`` is a staged table, for it is read several times. Null keys are a key; rows that tie in
    ``order`` are taken in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    # One pass over the counts: their sum, and of the keys with most rows as many as can be hot.
    most = counts.orderBy(F.desc("__n")).limit(4 * parts).select("__n").collect()
    each = max((rows.count() if most and most[0]["__n"] > few else 0) // (4 * parts), few)
    window = lambda t, *by: W.partitionBy(*by, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if t.before else 0)
    plain = {name: t.aggregate(t.value).over(window(t)) for name, t in totals.items()}
    if not most or most[0]["__n"] <= each:
        return rows.withColumns(plain)
    hot = counts.where(F.col("__n") > each).select(*[F.col(k).alias(f"__{k}") for k in keys])
    hot = F.broadcast(staged(hot, "hot"))
    same = _same({k: f"__{k}" for k in keys})
    cold = rows.join(hot, same, "left_anti").withColumns(plain)
    dealt = rows.join(hot, same, "left_semi").repartitionByRange(parts, *keys, *order)
    dealt = staged(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "__part").agg(*[t.aggregate(t.value).alias(f"__{name}") for name, t in totals.items()])
    ahead = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # at most one row a range
    sums = sums.withColumns({f"__{name}": t.aggregate(F.col(f"__{name}")).over(ahead) for name, t in totals.items()})
    sums = sums.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumnRenamed("__part", "__range")
    own = dealt.withColumns({name: t.aggregate(t.value).over(window(t, "__part")) for name, t in totals.items()})
    # There are fewer than two rows a range in all, for ranges follow one another.
    own = own.join(F.broadcast(sums), same & (F.col("__part") == F.col("__range")))
    merged = {name: F.coalesce(t.merge(F.col(f"__{name}"), F.col(name)), F.col(name), F.col(f"__{name}")) for name, t in totals.items()}
    return own.withColumns(merged).select(cold.columns).unionByName(cold)


def _same(names: dict[str, str]) -> Column:
    out = F.lit(True)
    for a, b in names.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def ordinal() -> Total:
    """The number of the row, from 1."""
    return added(F.lit(1).cast("long"))
