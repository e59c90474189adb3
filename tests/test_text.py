"""Normaliser: asserted inputs and edge cases."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T

CASES = [
    ("<ul><li>One <em>bold</em> claim</li></ul>?", "One bold claim?", None, None),
    ("first\nline\n\nsecond part\n\nthird", "first line\n\nsecond part\n\nthird", None, (1, 3)),
    ("<p>a</p><p>b</p>", "ab", ["ab"], (1, 1)),
    ("3 < 4 > 2", "3 < 4 > 2", ["3", "4", "2"], (1, 1)),
    ("a <!-- c --> b", "a <!-- c --> b", ["a", "c", "b"], (1, 1)),
    ("tail <b unclosed", "tail", ["tail"], (1, 1)),
    ("x <", "x <", ["x"], (1, 1)),
    ("<1> </> <a\nb>q", "<1>  q", ["1", "q"], (1, 1)),
    ("  x  \n \t\n\n y\t\tz \n", "x\n\ny\t\tz", ["x", "y", "z"], (1, 2)),
    ("a\r\nb\r\n\r\nc", "a b\n\nc", ["a", "b", "c"], (1, 2)),
    ("a.\u000bb\n\u000bc", "a.\u000bb c", ["a", "b", "c"], (1, 1)),
    (" a \nb", "a b", ["a", "b"], (1, 1)),
    ("Don't STOP_now, it’s 3.14 café ' 'hi'", None, ["don't", "stop", "now", "it", "s", "3", "14", "café", "'", "'hi'"], (1, 1)),
    ("!!!!!!!!!!!!", None, [], (12, 1)),
    ("...", None, [], (3, 1)),
    ("", "", [], (0, 0)),
    (" \n\t ", "", [], (0, 0)),
    (None, "", [], (0, 0)),
    ("ΟΔΟΣ İ", None, ["οδοσ", "i"], (1, 1)),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i long, text string")
    return {r["i"]: r for r in T.with_stats(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(rows, i):
    text, clean, tokens, counts = CASES[i]
    if clean is not None:
        assert rows[i]["clean_text"] == clean
    if tokens is not None:
        assert rows[i]["tokens"] == tokens
    if counts is not None:
        assert (rows[i]["sentence_count"], rows[i]["paragraph_count"]) == counts


def test_stats(spark):
    texts = ["Rain fell. Nobody minded it. Why?", "tick tick tock tock chime", "leaf " * 1000 + "."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r["i"]: r for r in T.with_stats(df).collect()}
    assert (got[0]["word_count"], got[0]["sentence_count"], got[0]["paragraph_count"], got[0]["type_token_ratio"]) == (6, 3, 1, 1.0)
    assert (got[1]["word_count"], got[1]["type_token_ratio"]) == (5, 0.6)
    assert got[2]["word_count"] == 1000


def test_long_text_is_whole(spark):
    df = spark.range(1).select(F.repeat(F.lit("ab cd. "), 200_000).alias("text"))
    r = T.with_stats(df).select("word_count", "sentence_count").first()
    assert tuple(r) == (400_000, 200_000)


def test_long_runs_of_white_space(spark):
    df = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" \t"), 300_000), F.lit("b \n\n"), F.repeat(F.lit(" \r\n"), 100_000), F.lit("c"), F.repeat(F.lit(" "), 300_000)).alias("text"))
    clean = df.select(T.clean(F.col("text")).alias("c")).first()["c"]
    assert clean == "a" + " \t" * 300_000 + "b\n\nc"
