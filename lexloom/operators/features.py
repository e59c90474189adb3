"""Lexicon features of documents.

Tokens are exploded, looked up in the lexicon and summed per document. A lexicon of up to
L.BROADCAST rows is broadcast; all tokens of a document then come from one row, so the sums are
complete before the shuffle, which carries one row a document. A larger one is joined as Spark chooses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import parts as P
from lexloom.sources import lexicon as L

STATS = ["word_count", "sentence_count", "paragraph_count", "type_token_ratio"]
BIG_WORD_BYTES = 6


def category_names(rows: list[tuple[str, str, int]]) -> list[str]:
    return list(dict.fromkeys(c for c, _, _ in rows))


def counted(docs: DataFrame, lex_rows: list[tuple[str, str, int]], key: str = "doc_id") -> DataFrame:
    """(key, word_count, covered, word_bytes, big_words_seen, cnt_<category>) of ``docs`` (key, text).

    Rows with the same key are one document in several parts, whose counts are summed; an unclosed tag ends
    with its row. Where it shouldn't, the words come from :mod:`lexloom.operators.parts`.
    """
    return counted_words(docs.select(key, F.explode_outer(T.tokens(T.clean(F.col("text")))).alias("__word")), lex_rows, key)


def counted_words(words: DataFrame, lex_rows: list[tuple[str, str, int]], key: str = "doc_id", wide: DataFrame | None = None, on: tuple[str, ...] | list[str] = ("__word",)) -> DataFrame:
    """As :func:`counted`, from ``words`` (key, __word): a row for each word, and a null word for keys without any.

    ``wide`` replaces the wide table of the lexicon, and is joined on the columns ``on``.
    """
    names = category_names(lex_rows)
    wide = L.wide(words.sparkSession, lex_rows, names).withColumnRenamed("word", "__word") if wide is None else wide
    hits = words.join(L.hinted(wide, len(lex_rows)), list(on), "left")
    size = F.octet_length("__word")
    known = F.col(f"m_{names[0]}").isNotNull() if names else F.lit(False)
    return hits.groupBy(key).agg(
        F.count("__word").alias("word_count"),
        F.sum(F.when(known, 1).otherwise(0)).alias("covered"),
        F.coalesce(F.sum(size), F.lit(0)).alias("word_bytes"),
        F.sum(F.when(size >= BIG_WORD_BYTES, 1).otherwise(0)).alias("big_words_seen"),
        *[F.expr(f"coalesce(sum(`m_{c}`), 0) AS `cnt_{c}`") for c in names],
    )


def share(part, n):
    """``part`` over ``n``, 0 where there are no words."""
    return F.when(n > 0, part / n).otherwise(F.lit(0.0))


def features(docs: DataFrame, lex_rows: list[tuple[str, str, int]], key: str = "doc_id") -> DataFrame:
    """(key, word_count, coverage, avg_word_length, big_word_ratio, pct_<category>)."""
    return shares(counted(docs, lex_rows, key), lex_rows, key)


def shares(counts: DataFrame, lex_rows: list[tuple[str, str, int]], *keys: str) -> DataFrame:
    """Features from the counts of :func:`counted`, or sums of these."""
    n = F.col("word_count")
    return counts.select(
        *keys,
        "word_count",
        share(F.col("covered"), n).alias("coverage"),
        share(F.col("word_bytes"), n).alias("avg_word_length"),
        share(F.col("big_words_seen"), n).alias("big_word_ratio"),
        *[F.expr(f"if(word_count > 0, `cnt_{c}` / word_count * 100, 0D) AS `pct_{c}`") for c in category_names(lex_rows)],
    )


def part_features(parts: P.Parts, lex_rows: list[tuple[str, str, int]]) -> DataFrame:
    """As :func:`features`, of documents in several rows exactly as if their parts had been joined."""
    return shares(counted_words(P.words(parts), lex_rows, parts.key), lex_rows, parts.key)


def evidence(docs: DataFrame, lex_rows: list[tuple[str, str, int]], key: str = "doc_id") -> DataFrame:
    """(key, category, word, hits): which words a document's percents come from."""
    if key in ("category", "word", "hits"):
        raise ValueError(f"a key can't be named {key} here")
    lex = L.lexicon(docs.sparkSession, lex_rows).select(F.col("word").alias("__word"), F.col("category").alias("__category"), F.col("mult").alias("__mult"))
    words = docs.select(key, F.explode(T.tokens(T.clean(F.col("text")))).alias("__word"))
    hits = words.join(L.hinted(lex, len(lex_rows)), "__word")
    return hits.groupBy(key, F.col("__category").alias("category"), F.col("__word").alias("word")).agg(F.sum("__mult").alias("hits"))
