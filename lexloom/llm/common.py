"""Helpers shared by the operators: table access, joins on hot keys, samples, slices; staged tables are the library's."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.joins import spread_join
from lexloom.sources.shared import file_system, new_path, shared_dir, staged

__all__ = ["file_system", "lowest_hashes", "new_path", "shared_dir", "slices", "spread_join", "staged", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def lowest_hashes(ids: DataFrame, bound: int, n: int, seed: int = 0) -> DataFrame:
    """About ``bound`` of the ``n`` rows ``ids`` (doc_id), and never more: those whose ids hash lowest.

    A threshold on the hash leaves few rows before any are sorted, however many partitions there are.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    few = ids.where(place < F.lit(min(1 << 40, int((1 << 40) * bound / max(n, 1)))))
    return few.orderBy(place, "doc_id").limit(bound)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of ``rows`` rows at most, so a task holds the Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
