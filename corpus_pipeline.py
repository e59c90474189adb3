"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir). ``run`` writes each stage's result to the shared folder
and hands what it reads back to the next.

Cases, of every stage: a null text is the empty text, and stays null where it stays; an id that is
null, or that several rows share, joins nothing to other rows, for decisions go by a row's own text;
other columns pass through unchanged, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import mixing, packing, secret_scan, simhash, toxicity
from lexloom.llm.common import staged, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject.

    Repeated rows are kept or go together. Without labels of both kinds the score of all is the share of toxic ones.
    """
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, of equal ids the one whose text hashes lowest, and of equal texts the one whose other columns do.

    Of a group's documents without an id one stays as well, for they can't be told to be the same as one with an id. Empty texts are one group.
    """
    return simhash.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kinds; ``n_chars`` follows the text. Equal texts are changed alike."""
    return secret_scan.redact(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources as often as their budgets say; rows with the same id, source and text are one unit, and so are equal ones without an id.

    A null source is one of its own. The rows have no order, for the next stage gives them their places.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a repeated row is packed once for each time."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
