"""The store: saves that are one step, whoever else saves, and lookups that read one bucket."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lexloom.sources import store as S

COLUMNS = [x.split()[0] for x in S.SCHEMA.split(", ")]


def rows(spark, ids, word_count=1):
    return spark.createDataFrame([(i, "blog", word_count, 0.5, "{}", "{}", "low", None, "other") for i in ids], f"{S.SCHEMA}, bucket string")


def ids_of(store):
    return sorted(r["id"] for r in store.table().collect())


def test_saves(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/s", 4)
    assert ids_of(store) == [] and store.row("a").count() == 0
    store.save(rows(spark, ["a", "b"]))
    store.save(rows(spark, ["c"]))
    store.save(rows(spark, []))
    assert ids_of(store) == ["a", "b", "c"] and store.table().columns == COLUMNS
    for ids, name in ((["d", "a"], "a"), (["e", "e"], "e"), (["f", None], "null"), ([None], "null")):
        with pytest.raises(ValueError, match=f"id is taken: {name}"):
            store.save(rows(spark, ids))
    assert ids_of(store) == ["a", "b", "c"] and len(list((tmp_path / "s" / "data").iterdir())) == 3
    assert ids_of(S.Store(spark, f"file://{tmp_path}/s", 99)) == ["a", "b", "c"]  # the store's own buckets hold
    store.save(rows(spark, ["d"]))
    assert [r["id"] for r in store.row("d").collect()] == ["d"] and store.row("e").count() == 0


def test_clashes(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/s", 4)
    ids = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "id string")
    assert {tuple(r) for r in store.clashes(ids).collect()} == {("b", 2, False), (None, 1, False)}
    store.save(rows(spark, ["a", "b", "x"]))
    assert {tuple(r) for r in store.clashes(ids).collect()} == {("a", 1, True), ("b", 2, True), (None, 1, False)}


def test_of_concurrent_saves_with_a_shared_id_one_wins(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/s", 4)
    store.save(rows(spark, ["old"]))
    start = threading.Barrier(4)

    def save(k):
        start.wait()
        try:
            S.Store(spark, store.path).save(rows(spark, ["shared", f"own {k}"], k))
            return True
        except ValueError as e:
            assert "shared" in str(e)
            return False

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(save, range(4)))
    assert won.count(True) == 1 and ids_of(store) == ["old", f"own {won.index(True)}", "shared"]


def test_concurrent_saves_of_other_ids_all_win(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/s", 4)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: S.Store(spark, store.path, 4).save(rows(spark, [f"id {k}"])), range(4)))
    assert ids_of(store) == [f"id {k}" for k in range(4)] and len(store.commits()) == 5


def test_a_saver_that_lost_the_race_looks_again(spark, tmp_path, monkeypatch):
    """Another save comes between the check and the commit."""
    store, other = (S.Store(spark, f"file://{tmp_path}/s", 4) for _ in range(2))
    store.create()
    commit, between = S.Store._commit, [["x"], ["b"]]

    def late(self, number, entry):
        if self is store and between:
            other.save(rows(spark, between.pop(0)))
        return commit(self, number, entry)

    monkeypatch.setattr(S.Store, "_commit", late)
    with pytest.raises(ValueError, match="id is taken: b"):
        store.save(rows(spark, ["a", "b"]))
    assert ids_of(store) == ["b", "x"]


def test_a_lost_save_is_not_seen(spark, tmp_path, monkeypatch):
    store = S.Store(spark, f"file://{tmp_path}/s", 4)
    store.save(rows(spark, ["a"]))
    with monkeypatch.context() as m:
        m.setattr(S.Store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.save(rows(spark, ["b"]))
    # And what a driver that is gone has left in the data folder isn't listed.
    rows(spark, ["c"]).drop("bucket").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{store.path}/data/save=lost")
    assert ids_of(store) == ["a"]
    store.save(rows(spark, ["b", "c"]))
    assert ids_of(store) == ["a", "b", "c"]


def test_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    own = rows(spark, [f"id {k}" for k in range(50)]).drop("bucket")
    S.Store(spark, f"file://{tmp_path}/s", 4).save(own.mapInPandas(count, S.SCHEMA))
    assert seen.value == 50


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/s", 8)
    for part in range(3):
        store.save(rows(spark, [f"{part}-{k}" for k in range(100)]))
    found = store.row("1-42")
    assert [r["id"] for r in found.collect()] == ["1-42"]
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 3  # one file of each save, of 24
    assert "EqualTo(id,1-42)" in plan.toString() and "PartitionFilters" in plan.toString()
