"""Token counts as delta-maintained rollups.

A batch of signed counts (inserts +, deletes -, revisions both) is summed by source, language
and tokenizer version before it is shuffled, and written as one directory that counts once
Spark has committed it. Committing a batch again changes nothing; an unfinished one is
replaced. Totals are the sums over committed batches, so no document is counted anew.

Cases: a null text is the empty text, with no tokens; a null source or language is a group of its
own; repeated rows count each time, and of equal texts all rows with the smallest id stay, and those without an id; deletes beyond the inserts show as negative totals; groups whose
documents and tokens are all gone are left out; empty batches are committed and add nothing; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import file_system, new_path, slices, spread_join, staged, table
from lexloom.llm.tokens import ByteBpe

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"
#: Tokenizer versions that the engine counts itself: runs without white space; runs of letters and digits, and other marks.
WORDS_1, WORDS_2 = r"[^\x20\x09-\x0D]+", r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
BPE = "byte_bpe_50k"


class Rollup:
    """Totals by source, language and tokenizer version, kept under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        return file_system(self.spark, path)

    def committed(self) -> list[str]:
        """The directories of the committed batches."""
        own, fs = self._fs(self.path)
        if not fs.exists(own):
            return []
        found = [str(x.getPath().toString()) for x in fs.listStatus(own)]
        return sorted(p for p in found if fs.exists(self._fs(f"{p}/_SUCCESS")[0]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds ``changes`` (source, lang, tokenizer, tokens, sign); False if ``batch`` has been committed before."""
        if any(p.endswith(f"/batch={batch}") for p in self.committed()):
            return False
        deltas = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        paths = self.committed()
        rows = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")


def signed(counts: DataFrame, tokenizer: str, column: str, sign: int) -> DataFrame:
    """Changes from ``counts``, of which ``column`` has the tokens."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(column).cast("long").alias("tokens"), F.lit(sign).alias("sign"))


def word_counts(pattern: str) -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(pattern)).cast("long")


def with_bpe(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds ``n_bpe`` and drops the text."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(vocabulary)
        for batch in slices(batches):
            n = [len(bpe.ids(t or "")) // 4 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64())], names=[*names, "n_bpe"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{schema}, n_bpe long")


def counted(docs: DataFrame, bpe: bool) -> DataFrame:
    """Every row's counts, and whether an equal text has a smaller id (``copy``)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "lang", F.unhex(F.sha2(text, 256)).alias("blob"), word_counts(WORDS_1).alias("n_words_1"), word_counts(WORDS_2).alias("n_words_2"), text.alias("text"))
    rows = staged(with_bpe(rows) if bpe else rows.drop("text"), "counts")
    groups = staged(rows.groupBy("blob").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "groups")
    rows = spread_join(rows, groups, ["blob"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    return staged(rows.drop("blob", "first"), "copies")  # every batch reads it


def maintained(spark: SparkSession, docs: DataFrame, bpe: bool = True) -> DataFrame:
    """Totals after four batches: all documents in, copies of equal texts out, counts of words revised to a new version, and the second batch once more."""
    rows, rollup = counted(docs, bpe), Rollup(spark, new_path(spark, "rollup"))
    kinds = [("words-1", "n_words_1"), *([(f"{BPE}-1", "n_bpe")] if bpe else [])]

    def all_of(rows: DataFrame, sign: int) -> DataFrame:
        parts = [signed(rows, name, column, sign) for name, column in kinds]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    rollup.commit("0001-insert", all_of(rows, 1))
    rollup.commit("0002-delete-copies", all_of(rows.where("copy"), -1))
    kept = rows.where("NOT copy")
    rollup.commit("0003-revise-words", signed(kept, "words-1", "n_words_1", -1).unionByName(signed(kept, "words-2", "n_words_2", 1)))
    rollup.commit("0002-delete-copies", all_of(rows.where("copy"), -1))
    return rollup.totals()


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version."""
    return maintained(spark, table(spark, sf_dir, "documents"))


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op7, without the tokenizer that SQL lacks."""
    return maintained(spark, table(spark, sf_dir, "documents"), bpe=False)


TOKEN_ROLLUP_WORDS_SQL = r"""
WITH kept AS (
  SELECT * FROM documents
  QUALIFY doc_id IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY coalesce(text, ''))
)
SELECT source, lang, 'words-2' AS tokenizer, count(*)::BIGINT AS docs,
       sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')))::BIGINT AS tokens
FROM kept GROUP BY source, lang
"""
