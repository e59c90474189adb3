"""Streams of documents whose parts come in different batches, against one job over all parts."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from lexloom.operators import features as feat
from lexloom.operators import profile as P
from lexloom.sources import lexicon as L
from lexloom.streaming import PartStream

LEX = L.load()
SCHEMA = "doc_id string, time timestamp, text string, first string"


def write(spark, folder, name, rows):
    """Rows (key, seconds, text) as a file of the stream's folder."""
    df = spark.createDataFrame(rows, "doc_id string, s double, text string")
    df.select("doc_id", F.timestamp_seconds("s").alias("time"), "text", F.lit("clash").alias("first")).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    (folder / "in").mkdir(exist_ok=True)
    for f in (folder / f"tmp-{name}").glob("part-*"):
        f.rename(folder / "in" / f"{name}.parquet")


def run(spark, folder, delay=100.0):
    own = PartStream(spark, f"file://{folder}/out", LEX, delay=delay)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")
    query = own.start(stream, f"file://{folder}/checkpoint")
    assert query.awaitTermination(300) and query.exception() is None
    return own


def scored(df):
    return {r["doc_id"]: tuple(r[c] for c in ("word_count", "coverage", "avg_word_length", "openness", "clout", "confidence_flag", "ci_width")) for r in df.collect()}


def whole(spark, rows):
    return scored(P.scores(feat.features(spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id string, text string"), LEX)))


def test_parts_in_different_batches(spark, tmp_path):
    rng = random.Random(4)
    words = ["happy", "think", "sad", "always", "I", "the", "goal", "xyz"]
    rows = [(f"d{k}", 10.0 * b + k % 7, " ".join(rng.choices(words, k=rng.randrange(12)))) for k in range(30) for b in range(5) if rng.random() > 0.3] + [(None, 3.0, "null key"), (None, 24.0, None), ("d1", 11.0, None)]
    for b in range(3):
        write(spark, tmp_path, f"a{b}", [r for r in rows if r[1] // 10 % 3 == b])
    own = run(spark, tmp_path)
    assert scored(own.current()) == whole(spark, rows) and own.closed().count() == 0 and own.late().count() == 0
    # A restart goes on from the state; two files more, one of them much later, so earlier documents are closed.
    more = [("d2", 45.0, "happy again"), ("new", 46.0, "think")]
    write(spark, tmp_path, "b0", more)
    write(spark, tmp_path, "b1", [("far", 1000.0, "goal goal")])
    own = run(spark, tmp_path)
    assert scored(own.current()) == whole(spark, rows + more + [("far", 1000.0, "goal goal")])
    assert own.closed().where("doc_id <=> 'far'").count() == 0 and own.closed().count() == own.current().count() - 1
    # Parts from before the watermark go aside, and so do those without a time.
    write(spark, tmp_path, "c0", [("d3", 5.0, "too late"), ("far", 990.0, "sad"), ("none", None, "no time")])
    own = run(spark, tmp_path)
    assert sorted((r["doc_id"], r["text"], r["first"]) for r in own.late().collect()) == [("d3", "too late", "clash"), ("none", "no time", "clash")]
    assert scored(own.current())["far"] == whole(spark, [("far", 0, "goal goal"), ("far", 0, "sad")])["far"]


def test_a_batch_that_runs_again(spark, tmp_path):
    """After a crash before the batch's commit, and after one in the middle of its writes."""
    parts = [[("a", 1.0, "happy think"), ("b", 2.0, "sad")], [("a", 3.0, "goal"), ("c", 200.0, "I")], [("c", 201.0, "the the")]]
    own = PartStream(spark, f"file://{tmp_path}/out", LEX, delay=50.0)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, s double, text string").select("doc_id", F.timestamp_seconds("s").alias("time"), "text")
    for number, rows in enumerate(parts):
        for attempt in range(3):
            own.batch(frame(rows), number)
            if attempt == 1:
                shutil.rmtree(tmp_path / "out" / "watermark" / f"batch={number}")
    assert scored(own.current()) == whole(spark, [r for rows in parts for r in rows])
    assert sorted(r["doc_id"] for r in own.closed().collect()) == ["a", "b"] and own.watermark(2) == 151.0


def test_empty_batches(spark, tmp_path):
    own = PartStream(spark, f"file://{tmp_path}/out", LEX)
    assert own.current() is None and own.closed() is None and own.late() is None
    nothing = spark.createDataFrame([], "doc_id string, time timestamp, text string")
    own.batch(nothing, 0)
    assert own.current().count() == 0
    own.batch(spark.createDataFrame([("a", "happy")], "doc_id string, text string").select("doc_id", F.timestamp_seconds(F.lit(9.0)).alias("time"), "text"), 1)
    own.batch(nothing, 2)
    assert scored(own.current()) == whole(spark, [("a", 9, "happy")])


@pytest.mark.parametrize("n", [4])
def test_old_states_are_deleted(spark, tmp_path, n):
    own = PartStream(spark, f"file://{tmp_path}/out", LEX)
    for number in range(n):
        own.batch(spark.createDataFrame([("a", "happy")], "doc_id string, text string").select("doc_id", F.timestamp_seconds(F.lit(9.0)).alias("time"), "text"), number)
    assert len([p for p in (tmp_path / "out" / "open").iterdir()]) <= 3 and own.current().first()["word_count"] == n
