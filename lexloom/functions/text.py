"""Text functions as Column expressions: markup, white space, tokens, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space by Unicode's property, for character classes; HORIZONTAL lacks the line feed. Fixed values.
WHITE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
HORIZONTAL = WHITE.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")
TAG = r"<[\p{L}/][^>]*(?:>|\z)"
WORD = r"[\p{L}\p{N}']+"
#: The same characters one by one.
SPACES = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip_markup(text: Column) -> Column:
    """Without tags: from ``<`` and a letter or slash to the next ``>``, or the end. Nothing takes a tag's place."""
    return F.regexp_replace(text, F.lit(TAG), F.lit(""))


def normalize_space(text: Column) -> Column:
    """Lines trimmed, and joined by a space; where blank lines were, one blank line; inner white space stays."""
    # No pattern looks at white space other than line feeds, and none backs up, so time is linear in the text.
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)))
    text = F.trim(F.array_join(lines, "\n"), F.lit("\n"))
    text = F.regexp_replace(text, F.lit(r"\n(?!\n)(?<!\n\n)"), F.lit(" "))
    return F.regexp_replace(text, F.lit(r"\n\n++"), F.lit("\n\n"))


def clean(text: Column) -> Column:
    return normalize_space(strip_markup(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    """Runs of letters, numbers and apostrophes, lower-cased letter by letter."""
    return F.regexp_extract_all(F.lower(F.translate(text, "İΣ", "iσ")), F.lit(WORD), F.lit(0))


def sentence_count(text: Column) -> Column:
    """How many of ``.!?``; a text with none of them, but with anything else, is one sentence."""
    marks = (F.char_length(text) - F.char_length(F.translate(text, ".!?", ""))).cast("long")
    some = F.char_length(F.regexp_replace(text, F.lit(rf"[{WHITE}]+"), F.lit(""))) > 0
    return F.when((marks == 0) & some, F.lit(1).cast("long")).otherwise(marks)


def paragraph_count(text: Column) -> Column:
    """Of a clean text."""
    return F.size(F.filter(F.split(text, "\n\n"), lambda x: x != "")).cast("long")


def type_token_ratio(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 0, F.size(F.array_distinct(words)) / n).otherwise(F.lit(0.0))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds clean_text, tokens, word_count, sentence_count, paragraph_count and type_token_ratio; a null text is the empty text."""
    return (
        docs.withColumn("clean_text", clean(F.col(text)))
        .withColumn("tokens", tokens(F.col("clean_text")))
        .withColumns(
            {
                "word_count": F.size("tokens").cast("long"),
                "sentence_count": sentence_count(F.col("clean_text")),
                "paragraph_count": paragraph_count(F.col("clean_text")),
                "type_token_ratio": type_token_ratio(F.col("tokens")),
            }
        )
    )
