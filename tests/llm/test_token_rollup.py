from collections import Counter

from lexloom.llm import token_rollup as R
from lexloom.llm.common import new_path
from tests.llm.conftest import MESSY
from tests.llm.test_packing import plain

CHANGE = "source string, lang string, tokenizer string, tokens long, sign int"


def totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=str)


def test_batches(spark):
    rollup = R.Rollup(spark, new_path(spark, "rollup"))
    assert totals(rollup) == []
    first = spark.createDataFrame([("a", "en", "t", 10, 1), ("a", "en", "t", 5, 1), (None, None, "t", 7, 1)], CHANGE)
    assert rollup.commit("1", first) and not rollup.commit("1", first)
    want = [("a", "en", "t", 2, 15), (None, None, "t", 1, 7)]
    assert totals(rollup) == sorted(want, key=str)
    revised = spark.createDataFrame([("a", "en", "t", 5, -1), ("a", "en", "t", 6, 1), (None, None, "t", 7, -1)], CHANGE)
    assert rollup.commit("2", revised)
    assert totals(rollup) == [("a", "en", "t", 2, 16)]
    assert rollup.commit("3", first.where("false")) and totals(rollup) == [("a", "en", "t", 2, 16)]
    assert rollup.commit("4", spark.createDataFrame([("z", "en", "t", 3, -1)], CHANGE))
    assert totals(rollup) == [("a", "en", "t", 2, 16), ("z", "en", "t", -1, -3)]


def test_unfinished_batches_do_not_count(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/rollup")
    changes = spark.createDataFrame([("a", "en", "t", 10, 1)], CHANGE)
    rollup.commit("1", changes)
    (tmp_path / "rollup" / "batch=1" / "_SUCCESS").unlink()
    assert totals(rollup) == []
    assert rollup.commit("1", changes) and totals(rollup) == [("a", "en", "t", 1, 10)]


def test_messy(spark, messy, nothing):
    import re

    smallest = {}
    for d, t, *_ in MESSY:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    want = Counter()
    docs = Counter()
    for d, t, lang, source in MESSY:
        if d is not None and d > smallest[t or ""]:
            continue
        n = len(re.findall(r"[^\W_]+|[^\w\s]|_", t or ""))
        for kind, k in (("words-2", n), ("byte_bpe_50k-1", len(plain(t)))):
            want[source, lang, kind] += k
            docs[source, lang, kind] += 1
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in R.maintained(spark, messy).collect()}
    bpe = {k: (docs[k], want[k]) for k in want if k[2].startswith("byte")}
    assert {k: v for k, v in got.items() if k[2].startswith("byte")} == bpe
    assert {k: v[0] for k, v in got.items()} == dict(docs)
    assert R.maintained(spark, nothing).count() == 0


def test_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["source", "lang", "tokenizer", "docs", "tokens"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({R.TOKEN_ROLLUP_WORDS_SQL})").fetchall()
    got = [tuple(r) for r in R.token_rollup_words(spark, sf).select(columns).collect()]
    assert sorted(got) == sorted(want)


def test_repeated_rows_against_sql(spark, messy, tmp_path):
    """Rows that repeat with id and text, rows without an id, ids that other texts share."""
    import duckdb

    more = spark.createDataFrame([(21, "twice over", "en", "r")] * 2 + [(22, "twice over", "en", "r"), (21, "another text", "de", "r"), (None, "twice over", None, "r")], "doc_id long, text string, lang string, source string")
    messy.select("doc_id", "text", "lang", "source").unionByName(more).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["source", "lang", "tokenizer", "docs", "tokens"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({R.TOKEN_ROLLUP_WORDS_SQL})").fetchall()
    got = [tuple(r) for r in R.token_rollup_words(spark, f"file://{tmp_path}").select(columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and ("r", "en", "words-2", 2, 4) in got
