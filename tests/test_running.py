import itertools
import random

from pyspark.sql import functions as F

from lexloom.operators import running as R
from lexloom.sources.shared import staged


def test_hot_and_cold_keys(spark):
    random.seed(3)
    keys = ["hot"] * 900 + [None] * 400 + [f"k{random.randrange(80)}" for _ in range(500)]
    rows = [(k, i if i % 50 else None, random.randrange(-9, 9)) for i, k in enumerate(keys)]
    df = staged(spark.createDataFrame(rows, "key string, at long, v long").repartition(5), "rows")
    totals = {"n": R.ordinal(), "s": R.added(F.col("v")), "x": R.xored(F.col("v")), "m": R.largest(F.col("v")), "b": R.added(F.col("v"), before=True)}
    want = set()
    for key in set(keys):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        values = [r[2] for r in own]
        for n, (r, s, x, m) in enumerate(zip(own, itertools.accumulate(values), itertools.accumulate(values, lambda a, b: a ^ b), itertools.accumulate(values, max), strict=True), 1):
            want.add((*r, n, s, x, m, s - r[2] if n > 1 else None))
    for few in (16, 1 << 20):  # dealt by ranges; windows only
        out = R.running(df, ["key"], [F.col("at").asc_nulls_first(), F.col("v")], totals, few)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(rows) and set(got) == want


def test_no_task_has_a_hot_key(spark):
    df = staged(spark.range(8000).select((F.col("id") % 1000 == 0).alias("key"), "id"), "rows")
    out = R.running(df, ["key"], [F.col("id").desc()], {"n": R.ordinal()}, 16)
    assert out.where("NOT key").agg(F.max("n"), F.min("n"), F.count_distinct("n")).first()[:] == (7992, 1, 7992)
    most = df.where("NOT key").repartitionByRange(4, "key", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 4000


def test_empty(spark):
    df = staged(spark.createDataFrame([], "key string, at long"), "rows")
    assert R.running(df, ["key"], [F.col("at")], {"n": R.ordinal()}).collect() == []
