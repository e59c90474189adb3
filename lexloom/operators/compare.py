"""Comparisons of scores: ranks among all, groups of several kinds at once, and subjects over time.

The ranks, groups and courses of one subject may take all rows of a table, so none is a window over them: ranks are
running counts over the different values, groups are sums of partial counts, and courses are running sums whose
ranges are shared (:mod:`lexloom.operators.running`).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.features import counted, shares
from lexloom.operators.joins import spread_join
from lexloom.operators.profile import scores
from lexloom.operators.running import added, ordinal, running
from lexloom.sources.shared import staged

#: Different values whose ranks are broadcast to the rows, some 5 MB.
VALUES = 100_000


def ranked(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``percent_rank`` and ``cume_dist`` of ``value`` among all rows of the same ``keys``, exactly.

    A null value has no rank and counts as none; null keys are a key; equal values share a rank.
    """
    # Keys are made texts, null too, so that joins meet them.
    names = [f"__k{i}" for i in range(len(keys))]
    rows = rows.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for n, k in zip(names, keys, strict=True)} | {"__v": F.col(value)})
    counts = staged(rows.where("__v IS NOT NULL").groupBy(*names, "__v").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy(*names).agg(F.sum("n").alias("__total"))
    summed = running(counts, names, [F.col("__v")], {"__before": added(F.col("n"), before=True)}).join(totals, names)
    before = F.coalesce("__before", F.lit(0))
    found = summed.select(
        *names, "__v", "n",
        F.when(F.col("__total") > 1, before / (F.col("__total") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
        ((before + F.col("n")) / F.col("__total")).alias("cume_dist"),
    )
    found, on = staged(found, "ranks"), [*names, "__v"]
    joined = rows.join(F.broadcast(found.drop("n")), on, "left") if found.count() <= VALUES else spread_join(rows, found, on, "left")
    return joined.drop(*on)


def grouped(docs: DataFrame, lex_rows: list[tuple[str, str, int]], dims: list[str], sets: list[list[str]], model: Mapping[str, Column] | None = None) -> DataFrame:
    """(dims, level, word_count, ..., scores): the texts of each group of each of ``sets`` of ``dims`` as one document each.

    Words are counted once, by all of ``dims``; the sets are sums of these counts, few rows. ``level`` has a bit for each of ``dims``, the
    first one the highest, set where a group goes over all its values; a null value is a value.
    """
    own = counted(docs.select(F.struct(*dims).alias("__dims"), "text"), lex_rows, "__dims")
    names = [c for c in own.columns if c != "__dims"]
    own = own.select("__dims.*", *[F.col(f"`{c}`") for c in names])
    sums = own.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(F.grouping_id().alias("level"), *[F.sum(f"`{c}`").alias(c) for c in names])
    return scores(shares(sums, lex_rows, *dims, "level"), model)


def courses(rows: DataFrame, subject: str, order: str, value: str, last: int = 3) -> DataFrame:
    """``rows`` with ``n``, their place among their subject's, ``recent``, the mean of the last ``last`` values, and ``step``, the difference from the value before.

    Values are scores of two digits, so sums of hundredths are exact. A null value counts as none in ``recent``; ``step`` is null where
    either is; rows that tie in the order are taken in any order; a null subject is a subject.
    """
    cents = F.round(F.col(value) * 100).cast("long")
    rows = staged(rows.withColumns({"__s": F.coalesce(F.concat(F.lit("="), F.col(subject).cast("string")), F.lit("")), "__c": cents, "__row": F.monotonically_increasing_id()}), "rows")
    totals = {"n": ordinal(), "__sum": added(F.coalesce("__c", F.lit(0))), "__some": added(F.col("__c").isNotNull().cast("long"))}
    own = staged(running(rows, ["__s"], [F.col(order), F.col("__row")], totals), "sums")
    earlier = own.select("__s", (F.col("n") + last).alias("n"), F.col("__sum").alias("__sum0"), F.col("__some").alias("__some0"))
    before = own.select("__s", (F.col("n") + 1).alias("n"), F.col("__c").alias("__c0"))
    own = own.join(earlier, ["__s", "n"], "left").join(before, ["__s", "n"], "left")  # one row each
    some = F.col("__some") - F.coalesce("__some0", F.lit(0))
    recent = F.when(some > 0, (F.col("__sum") - F.coalesce("__sum0", F.lit(0))) / some / 100)
    return own.withColumns({"recent": recent, "step": (F.col("__c") - F.col("__c0")) / 100}).drop("__s", "__c", "__row", "__sum", "__some", "__sum0", "__some0", "__c0")


def changes(rows: DataFrame, subject: str, order: str, value: str) -> DataFrame:
    """(subject, n, change, last_before, mean_before, mean_after): where each subject's values change most.

    After the first ``change`` of its ``n`` values the running sum is farthest from the straight line to the whole sum, the
    earliest place if there are several; none for subjects with fewer than two values, or with equal ones. Null values are left out.
    """
    cents = F.round(F.col(value) * 100).cast("long")
    rows = rows.where(F.col(value).isNotNull()).select(F.col(subject), F.col(order).alias("__o"), cents.alias("__c"), F.monotonically_increasing_id().alias("__row"))
    rows = staged(rows.withColumn("__s", F.coalesce(F.concat(F.lit("="), F.col(subject).cast("string")), F.lit(""))), "rows")
    whole = staged(rows.groupBy("__s").agg(F.count("*").alias("n"), F.sum("__c").alias("__all")), "whole")
    own = running(rows, ["__s"], [F.col("__o"), F.col("__row")], {"__n": ordinal(), "__sum": added(F.col("__c"))})
    own = spread_join(own, whole.withColumn("__total", F.col("n")), ["__s"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    far = F.abs(wide("__total") * wide("__sum") - wide("__n") * wide("__all"))
    own = own.where(F.col("__n") < F.col("__total")).withColumn("__far", far)
    best = own.groupBy("__s").agg(F.max(F.struct("__far", (-F.col("__n")).alias("m"), "__sum", "__o", subject, "__total", "__all")).alias("b")).where("b.__far > 0")
    k, n = -F.col("b.m"), F.col("b.__total")
    return best.select(
        F.col(f"b.{subject}").alias(subject), n.alias("n"), k.alias("change"), F.col("b.__o").alias("last_before"),
        (F.col("b.__sum") / k / 100).alias("mean_before"), ((F.col("b.__all") - F.col("b.__sum")) / (n - k) / 100).alias("mean_after"),
    )
