from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.llm.common import spread_join, staged


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, how):
    """Hot, rare, missing and null keys, in two columns; a hot key's rows lie in several partitions."""
    rows = [(i, "hot" if i % 3 else f"k{i}", i % 2 if i % 50 else None) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id long, a string, b int")
    keyed = staged(frame.where("a <> 'k9' AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("first")), "keyed")
    got = spread_join(frame.withColumn("__place", F.spark_partition_id()), keyed, ["a", "b"], how).drop("__place")
    first = {}
    for i, a, b in rows:
        if a != "k9" and b is not None:
            first.setdefault((a, b), i)
    want = [(a, b, i, first.get((a, b))) for i, a, b in rows if how == "left" or (a, b) in first]
    assert sorted(map(tuple, got.select("a", "b", "id", "first").collect()), key=str) == sorted(want, key=str)
    spread = spread_join(frame, keyed, ["a", "b"], how)
    sizes = Counter(r["p"] for r in spread.where("a = 'hot'").select(F.spark_partition_id().alias("p")).collect())
    assert sum(sizes.values()) >= 1300
    assert spread_join(frame.where("false"), keyed.where("false"), ["a", "b"], how).count() == 0
