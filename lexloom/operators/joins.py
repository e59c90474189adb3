"""Joins on keys that a third of all rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``: a staged table of one row a key, and in ``n`` how many of ``rows`` have it.

    The rows of a key that very many share are dealt to several tasks, and the key's row to each
    of them. Such keys have more than the N / (4 * partitions)th part of the N rows, so there are fewer than
    4 * partitions of them, and only they are broadcast. ``n`` is dropped; null keys join nothing.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max((keyed.agg(F.sum("n")).first()[0] or 0) // (4 * parts), 16)
    dealt = F.least(F.ceil(F.col("n") / each), F.lit(4 * parts)).cast("int")
    hot = keyed.where(F.col("n") > each).select(*[F.col(c).alias(f"__{c}") for c in on], dealt.alias("__parts"))
    same = [F.col(c) == F.col(f"__{c}") for c in on]
    rest = [c for c in rows.columns if c not in on]
    place = F.pmod(F.xxhash64(F.spark_partition_id(), *rest), F.coalesce("__parts", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), same, "left").withColumn("__salt", place).select(*rows.columns, "__salt")
    places = F.sequence(F.lit(0), F.when(F.col("n") > each, dealt).otherwise(1) - 1)
    keyed = keyed.withColumn("__salt", F.explode(places)).drop("n")
    return salted.join(keyed, [*on, "__salt"], how).drop("__salt")
