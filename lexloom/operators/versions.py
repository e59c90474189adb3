"""Lexicons that change: each document by the version that held on its date.

The as-of join is one of dates, not of documents: the different dates and the versions' first days are
one sequence, in which the last version that began is a running maximum. Documents get their version by an
equal date, and their words meet the version's own words: no range join, and no window over documents.

Cases: a document without a date, or with one that isn't real, and one from before the first version have no version, and no
word of theirs is known; of versions that begin on one day the greatest name holds; null texts have no words; an
empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.features import category_names, counted_words, shares
from lexloom.operators.joins import spread_join
from lexloom.operators.running import largest, running
from lexloom.functions import text as T
from lexloom.sources.shared import staged

#: Different dates whose versions are broadcast: some 5 MB.
DATES = 100_000
Rows = list[tuple[str, str, int]]


def as_of(rows: DataFrame, date: Column, versions: DataFrame) -> DataFrame:
    """``rows`` with ``version``: that of ``versions`` (first date, version string) which began last on or before ``date``."""
    rows = rows.withColumn("__date", date)
    dates = staged(rows.where("__date IS NOT NULL").groupBy("__date").agg(F.count("*").alias("n")), "dates")
    began = versions.where("first IS NOT NULL").select(F.lit(0).alias("one"), F.col("first").cast("date").alias("day"), F.col("version").alias("v"), F.lit(None).cast("long").alias("n"))
    both = staged(dates.select(F.lit(0).alias("one"), F.col("__date").alias("day"), F.lit(None).cast("string").alias("v"), "n").unionByName(began), "sequence")
    # On one day the versions come before the dates, so a version holds from its first day on.
    latest = F.when(F.col("v").isNotNull(), F.struct("day", "v"))
    found = running(both, ["one"], [F.col("day"), F.col("v").isNull()], {"last": largest(latest)}).where("v IS NULL")
    found = staged(found.select(F.col("day").alias("__date"), F.col("last.v").alias("version"), "n"), "versions")
    out = rows.join(F.broadcast(found.drop("n")), "__date", "left") if found.count() <= DATES else spread_join(rows, found, ["__date"], "left")
    return out.drop("__date")


def wide(spark: SparkSession, lexicons: dict[str, Rows], names: list[str]) -> DataFrame:
    """One row a version and word, with the multiplicity of each category in ``m_<category>``."""
    by_word: dict[tuple[str, str], dict[str, int]] = {}
    for version, rows in lexicons.items():
        for category, word, n in rows:
            own = by_word.setdefault((version, word), dict.fromkeys(names, 0))
            own[category] += n
    columns = {"__version": pa.array([v for v, _ in by_word], pa.string()), "__word": pa.array([x for _, x in by_word], pa.string())}
    columns |= {f"m_{c}": pa.array([own[c] for own in by_word.values()], pa.int32()) for c in names}
    return spark.createDataFrame(pa.table(columns))


def features(docs: DataFrame, lexicons: dict[str, tuple[str, Rows]], key: str = "doc_id", date: str = "source_date") -> DataFrame:
    """(key, version, features) of ``docs`` (key, text, date as yyyy-MM-dd): by name, ``lexicons`` has each version's first date and rows."""
    spark = docs.sparkSession
    day = F.when(F.col(date).rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd")).cast("date"))
    versions = spark.createDataFrame([(first, name) for name, (first, _) in lexicons.items()], "first string, version string")
    own = as_of(docs.select(key, "text", date), day, versions)
    words = own.select(F.struct(key, "version").alias("__key"), F.coalesce("version", F.lit("")).alias("__version"), F.explode_outer(T.tokens(T.clean(F.col("text")))).alias("__word"))
    rows = {name: r for name, (_, r) in lexicons.items()}
    every = [x for r in rows.values() for x in r]
    counts = counted_words(words, every, "__key", wide(spark, rows, category_names(every)), ["__version", "__word"])
    return shares(counts, every, "__key").select("__key.*", "*").drop("__key")
