"""Lexicons: words and their categories, as DataFrames.

A lexicon is a parameter: a JSON object of word lists by category, or a text file with a line
``category: word, word`` for each; lines that start with ``#`` are comments. Words are trimmed and
lower-cased, blank ones dropped, and repeated ones counted (``mult``).
"""

from __future__ import annotations

import json
import os
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lexicon that may be broadcast: some 20 MB.
BROADCAST = 200_000
SCHEMA = "category string, word string, mult int"
#: The default lexicon, which comes with the package.
DEFAULT = os.environ.get("LEXLOOM_LEXICON", str(Path(__file__).with_name("lexicon.txt")))


def parse(text: str) -> dict[str, list[str]]:
    """Word lists by category, from JSON or the text form."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    lines = (x for x in text.splitlines() if x.strip() and not x.startswith("#"))
    return {c.strip(): words.split(",") for c, _, words in (x.partition(":") for x in lines)}


def entries(lists: dict[str, list[str]]) -> list[tuple[str, str, int]]:
    """(category, word, mult), categories and words in the order they come."""
    counted = Counter((c, word) for c, words in lists.items() for x in words if (word := x.strip().lower()))
    return [(c, word, n) for (c, word), n in counted.items()]


def load(path: str = DEFAULT) -> list[tuple[str, str, int]]:
    return entries(parse(Path(path).read_text(encoding="utf-8")))


def lexicon(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    category, word, mult = ([r[k] for r in rows] for k in range(3))
    return spark.createDataFrame(pa.table({"category": pa.array(category, pa.string()), "word": pa.array(word, pa.string()), "mult": pa.array(mult, pa.int32())}))


def hinted(lex: DataFrame, rows: int) -> DataFrame:
    """``lex``, with a hint to broadcast it where it has few rows."""
    return F.broadcast(lex) if rows <= BROADCAST else lex


def lookup(words: DataFrame, lex: DataFrame) -> DataFrame:
    """``words`` (word) with the categories of each, an empty list where there are none."""
    by_word = lex.groupBy("word").agg(F.array_sort(F.collect_list("category")).alias("categories"))
    none = F.array().cast("array<string>")
    keyed = words.withColumn("__key", F.lower("word")).join(by_word.withColumnRenamed("word", "__key"), "__key", "left")
    return keyed.drop("__key").withColumn("categories", F.coalesce("categories", none))


def categories(lex: DataFrame) -> DataFrame:
    return lex.select("category").distinct()


def wide(spark: SparkSession, rows: list[tuple[str, str, int]], names: list[str]) -> DataFrame:
    """One row a word, with the multiplicity of each category in ``m_<category>``: a table of a lexicon's size."""
    by_word: dict[str, dict[str, int]] = {}
    for category, word, n in rows:
        own = by_word.setdefault(word, dict.fromkeys(names, 0))
        own[category] += n
    columns = {"word": pa.array(by_word, pa.string())} | {f"m_{c}": pa.array([own[c] for own in by_word.values()], pa.int32()) for c in names}
    return spark.createDataFrame(pa.table(columns))
