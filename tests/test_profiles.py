"""Narratives, PDF files, the store, sources, validation, streams, the registered queries."""

import json
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from lexloom.functions import weights as w
from lexloom.operators import analyze as A
from lexloom.operators import narrative as N
from lexloom.operators import profile as P
from lexloom.operators import validation as V
from lexloom.plans import queries as Q
from lexloom.sources import lexicon as L
from lexloom.sources import texts
from lexloom.sources.store import Store, rows_of
from lexloom.streaming import profile_stream

SF = "/root/testdata/sf0.001"
LEX = L.load()


@pytest.fixture(scope="module")
def profiles(spark):
    df = spark.createDataFrame([(1, "happy think achieve friend sad always I accommodate the the " * 60), (2, "")], "doc_id long, text string")
    return N.with_narrative(P.profiles(df, LEX, analysis_id=F.concat(F.lit("id-"), "doc_id"))).cache()


def test_narrative(profiles):
    got = {r["doc_id"]: r["narrative"] for r in profiles.collect()}
    assert got[1].startswith("## Psychological Profile\n\n**Confidence level:** medium\n\n### Big Five (OCEAN)\n\n**Openness:** 0.39 (moderate) — 18th percentile (95% CI: ")
    for heading in ("### Regulatory Focus", "### Need for Cognition", "### Cognitive Style", "### Need for Closure", "### Schwartz Value Orientation", "### Summary Variables"):
        assert heading in got[1]
    assert "- **Analytical Thinking:** 0.92 — highly analytical\n" in got[1] and got[1].endswith(f"\n---\n*{N.FOOTER}*")
    assert "**Confidence level:** low" in got[2] and "(balanced)" in got[2]
    lines = [x for x in got[1].splitlines() if x.endswith("% of words")]
    percents = [float(x.split(":** ")[1].split("%")[0]) for x in lines]
    assert len(lines) == 10 and percents == sorted(percents, reverse=True)


def test_exact_digits(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.285,)], "x double")
    assert [r[0] for r in df.select(N.exact2("x")).collect()] == ["0.12", "2.67", "0.28"]


def test_pdf(profiles):
    for r in N.pdfs(profiles).collect():
        assert bytes(r["pdf"]).startswith(b"%PDF-") and bytes(r["pdf"]).rstrip().endswith(b"%%EOF") and len(r["pdf"]) > 1000
    none = profiles.withColumns({"traits": F.map_filter("traits", lambda k, v: F.lit(False)), "narrative": F.lit("")})
    assert all(bytes(r["pdf"]).startswith(b"%PDF-") for r in N.pdfs(none).collect())


def test_pdfs_hold_the_lines_of_few_files_at_a_time(spark, profiles):
    """Whatever the rows of an Arrow batch; each line is some four objects."""
    one = profiles.limit(1).localCheckpoint().drop("doc_id")
    held = lambda n: N.pdfs(spark.range(n).coalesce(1).withColumnRenamed("id", "doc_id").join(F.broadcast(one)), render=lambda lines: str(sys.getallocatedblocks()).encode()).agg(F.max(F.col("pdf").cast("string").cast("long"))).first()[0]
    assert held(3000) < held(1) + 150_000


def test_ids_of_pdfs_are_exact(spark, profiles):
    ids = spark.createDataFrame([(2**53 + 1,), (None,)], "doc_id long").coalesce(1)
    got = N.pdfs(ids.join(F.broadcast(profiles.limit(1).drop("doc_id")))).collect()
    assert {r["doc_id"] for r in got} == {2**53 + 1, None} and all(bytes(r["pdf"]).startswith(b"%PDF-") for r in got)


def test_store(spark, profiles, tmp_path):
    store = Store(spark, f"file://{tmp_path}/analyses")
    store.create()
    assert store.table().count() == 0
    store.save(rows_of(profiles, "blog"))
    p = store.profile("id-1").first()
    assert p["confidence_flag"] == "medium" and p["traits"]["openness"]["score"] == 0.39 and p["narrative"].startswith("## ")
    a = store.analysis("id-1").first()
    assert (a["source_type"], a["word_count"]) == ("blog", 600) and a["features"]["article"] == 20.0 and a["profile"]["values"]["value_achievement"] == 10.0
    assert store.analysis("id-2").first()["features_json"] == "null"
    assert store.profile("missing").count() == 0
    with pytest.raises(ValueError, match="taken"):
        store.save(rows_of(profiles.where("doc_id = 1")))
    assert store.table().count() == 2


def test_sources(spark, tmp_path):
    for name, text in (("b.txt", "two"), ("A.TXT", "one"), ("c.md", "no"), ("d.json", "no")):
        (tmp_path / name).write_text(text)
    r = texts.joined_files(spark, f"file://{tmp_path}").first()
    assert (r["text"], r["files_read"]) == ("one\n\ntwo", 2)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.md").write_text("no")
    with pytest.raises(FileNotFoundError):
        texts.joined_files(spark, f"file://{tmp_path}/none")


def test_fetch(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("status 404")
        return f"text of {url}"

    rows = [("x", "url", None, "http://good.example"), (None, "url", None, "http://bad.example"), ("own text here", "blog", None, None)]
    got = V.validated(texts.fetched(spark.createDataFrame(rows, V.REQUEST), fetch), fetched=True).collect()
    assert [r["text"] for r in got] == ["text of http://good.example", None, "own text here"]
    assert [r["reject"] for r in got] == [None, "failed to fetch URL: status 404", None]


#: Requests, each with its first failed rule.
REQUESTS = (
    ("ten bytes or more", "blog", "2024-03-15", None, None), ("ten bytes or more", None, None, None, "SourceType: required"), ("ten bytes or more", "podcast", "2024-3-15", None, "SourceType: oneof; SourceDate: datetime"),
    ("ten bytes or more", "url", None, None, "source_url is required when source_type=url"), ("ééééé", "paste", "", "", None), ("123456789", "paste", None, None, "text must be at least 10 characters"), ("x" * 1_000_001, "paste", None, None, "text exceeds max size"),
    ("ten bytes or more", "email", "2024-02-30", None, "SourceDate: datetime"), ("ten bytes or more", "url", None, "https://example.org/a", None), (None, "chat", None, None, "text must be at least 10 characters"), ("x" * 1_000_000, "file", None, "no address", "SourceURL: url"),
)


def test_validation(spark):
    rows = V.validated(spark.createDataFrame([(i, *r) for i, r in enumerate(REQUESTS)], f"i int, {V.REQUEST}, want string")).collect()
    assert [r["reject"] for r in rows] == [r["want"] for r in rows]
    lines = spark.createDataFrame([('{"text": "ten bytes or more", "source_type": "blog"}',), ("not json",)], "value string")
    assert [r["reject"] for r in V.parsed(lines).collect()] == [None, "invalid JSON"]


@pytest.mark.parametrize("name", ["validate_requests", "validate_folder_requests"])
def test_requests_of_documents_fail_every_rule(spark, name):
    rejects = {part for r in Q.queries()[name](spark, "/root/testdata/sf0.01").collect() for part in (r["reject"] or "").split("; ")}
    every = {"", "SourceType: oneof", "SourceDate: datetime"}
    assert rejects == every | ({"dir_path not configured"} if "folder" in name else {"SourceType: required", "SourceURL: url", "source_url is required when source_type=url", "text must be at least 10 characters", "text exceeds max size"})


def test_services(spark, tmp_path):
    text = "happy think achieve friend sad always I accommodate the"
    rows = [(1, text, "blog", None, None), (2, text, "podcast", None, None), (3, None, "url", None, "http://x.example"), (4, "short", "chat", None, None)]
    requests = spark.createDataFrame(rows, "request_id long, " + V.REQUEST)
    responses, rejects = A.analyze(requests, LEX, fetch=lambda url: f"fetched {url}")
    assert {r["request_id"]: r["reject"] for r in rejects.collect()} == {2: "SourceType: oneof", 4: "text must be at least 10 characters"}
    got = {r["request_id"]: r for r in responses.collect()}
    assert set(got) == {1, 3} and got[1]["traits"]["openness"]["score"] == 0.24 and len(got[1]["analysis_id"]) == 36
    saved = responses.where("request_id = 1").cache()
    store = Store(spark, f"file://{tmp_path}/analyses")
    A.save(store, saved, "blog")
    pdf = A.pdf_of(store, saved.first()["analysis_id"]).collect()
    assert len(pdf) == 1 and bytes(pdf[0]["pdf"]).startswith(b"%PDF-") and A.pdf_of(store, "none").count() == 0
    line = json.loads(A.as_json(saved).first()["value"])
    assert line["word_count"] == 9 and line["traits"]["openness"]["confidence_interval"] == [0.0, 0.49]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(text)
    r = A.analyze_folder(spark, f"file://{tmp_path}", LEX).first()
    assert (r["files_read"], r["word_count"], r["source_type"], r["summary"]["clout"]) == (2, 18, "file", 0.9)
    with pytest.raises(ValueError, match="max size"):
        A.analyze_folder(spark, f"file://{tmp_path}", LEX, config=texts.Config(max_text_size=20))


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "happy and sad"), (2, "the")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    query = profile_stream(source, LEX, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


ORACLE = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    if name not in ORACLE:
        assert name == "fitted_scores" and len(rows) == 200  # SQL solves no equations: test_versions has a plain solver
        return
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE[name]})").fetchall()
    assert rows == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", *w.BIG_FIVE_TRAITS] and df.count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_exact_digits_of_many_numbers(spark):
    """Against C's formatting: all ties, their neighbours, and percents of counts."""
    ties = [(2 * k + 1) / 200 for k in range(20_000)]
    values = ties + [math.nextafter(x, y) for x in ties for y in (0.0, 1e9)] + [a / b * 100 for b in (7, 32, 123, 800, 1600) for a in range(b + 1)] + [0.0, 1e-300, 0.005, 99.995, 300.0, 12345.675]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double").orderBy("i").select(N.exact2("x")).collect()]
    assert got == [f"{x:.2f}" for x in values]
    assert [r[0] for r in spark.createDataFrame([(None,), (float("nan"),)], "x double").select(N.exact2(F.col("x"))).collect()] == [None, None]


def test_narratives_have_no_python(spark):
    plan = Q.narrative(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_lookup_reads_by_the_id(spark, profiles, tmp_path):
    store = Store(spark, f"file://{tmp_path}/analyses")
    store.save(rows_of(profiles))
    plan = store.profile("id-1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,id-1)" in plan and "features_json" not in plan.split("ReadSchema")[1]


def test_only_valid_requests_are_fetched_and_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def fetch(url):
        (log / os.urandom(8).hex()).write_text(url)
        return "text of ten bytes or more"

    rows = [(1, None, "url", "2024-13-99", "http://a.example"), (2, None, "url", None, "http://b.example"), (3, "kept", "blog", None, "http://c.example"), (4, None, "url", None, "http://b.example"), (5, None, "url", None, "nonsense")]
    responses, rejects = A.analyze(spark.createDataFrame(rows, "request_id long, " + V.REQUEST), LEX, fetch=fetch)
    assert {r["request_id"] for r in responses.collect()} == {2, 4}
    assert {r["request_id"]: r["reject"] for r in rejects.collect()} == {1: "SourceDate: datetime", 3: "text must be at least 10 characters", 5: "SourceURL: url"}
    assert [f.read_text() for f in log.iterdir()] == ["http://b.example"]
    for url in ("file:///etc/hosts", "ftp://x.example/y"):
        with pytest.raises(ValueError, match="not an http address"):
            texts.fetch_text(url)


def test_folder_rules(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("x" * 50)
    folder = f"file://{tmp_path}"
    for own, rule in (({"folder": None}, "dir_path not configured"), ({"source_type": "podcast", "folder": None}, "SourceType: oneof"), ({"source_date": "2024-02-30"}, "SourceDate: datetime")):
        with pytest.raises(ValueError, match=rule):
            A.analyze_folder(spark, **({"folder": folder, "lex_rows": LEX} | own))
    monkeypatch.setattr(texts, "joined_files", lambda *a: pytest.fail("read before the size was checked"))
    for most, rule in ((49, "combined text exceeds max size"), (0, None)):
        if rule:
            with pytest.raises(ValueError, match=rule):
                A.analyze_folder(spark, folder, LEX, config=texts.Config(max_text_size=most))
    (tmp_path / "a.txt").write_text("x" * 9)
    with pytest.raises(ValueError, match="combined text must be at least 10 characters"):
        A.analyze_folder(spark, None, LEX, config=texts.Config(dir_path=folder))


def test_config(spark, tmp_path):
    assert texts.Config.load(spark) == texts.Config()
    (tmp_path / "c.yaml").write_text("app: {http: {port: '1'}}\nmiddleware: {timeout_in_second: 7}\ningest: {max_text_size: 20, dir_path: texts}\nanalyze: {dictionary_path: d.json}\nprofile: {db_path: p}\n")
    path = f"file://{tmp_path}/c.yaml"
    want = texts.Config(max_text_size=20, fetch_timeout=7.0, dir_path="texts", dictionary_path="d.json", db_path="p")
    assert texts.Config.load(spark, path) == want
    spark.conf.set("spark.lexloom.max_text_size", "30")
    try:
        assert texts.Config.load(spark, path).max_text_size == 30
    finally:
        spark.conf.unset("spark.lexloom.max_text_size")


def test_models_and_renderers_are_parameters(spark, tmp_path):
    docs = spark.createDataFrame([(1, "happy happy sad words and more")], "request_id long, text string")
    requests = docs.selectExpr("*", "'blog' AS source_type", "CAST(NULL AS string) AS source_date", "CAST(NULL AS string) AS source_url")
    model = {"openness": F.lit(0.9), "neuroticism": F.col("pct_positive_emotion") / 100}
    responses, _ = A.analyze(requests, LEX, fetch=None, model=model, narrator=lambda p: p.withColumn("narrative", F.concat(F.lit("own: "), F.col("confidence_flag"))))
    r = responses.first()
    assert r["traits"]["openness"]["score"] == 0.9 and r["traits"]["neuroticism"]["score"] == pytest.approx(2 / 6) and r["traits"]["need_for_closure"]["score"] == 0.5
    assert r["narrative"] == "own: low"
    store = Store(spark, f"file://{tmp_path}/a")
    saved = spark.createDataFrame(responses.collect(), responses.schema)
    A.save(store, saved, "blog")
    pdf = A.pdf_of(store, saved.first()["analysis_id"], render=lambda lines: "|".join(t for _, t in lines).encode()).first()["pdf"]
    assert bytes(pdf).startswith(b"Psychological Profile|Confidence level: low")
    with pytest.raises(ValueError, match="not traits"):
        P.profiles(docs, LEX, "request_id", model={"luck": F.lit(1.0)})


def test_shared_folder(spark, monkeypatch):
    from lexloom.sources import shared

    path = shared.new_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and shared.new_path(spark, "x") != path

    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"getConf": lambda self: {}, "getCheckpointDir": lambda self: None, "master": "spark://host:7077", "applicationId": "a"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster())
    Cluster.sparkContext.__class__.getCheckpointDir = lambda self: "hdfs://x/y/"
    assert shared.shared_dir(Cluster()) == "hdfs://x/y"


def test_few_splits_are_dealt_to_all_cores(spark):
    from lexloom.sources.shared import spread

    df = spark.range(100).repartition(1)
    assert spread(df, "id").rdd.getNumPartitions() == 4 and spread(spark.range(100, numPartitions=9), "id").rdd.getNumPartitions() == 9
