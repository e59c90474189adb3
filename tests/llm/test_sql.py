"""The registered SQL of this subpackage against its queries."""

import time

import duckdb
import pytest

from lexloom.llm import queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_exponion", "quality_counts"])
def test_against_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    own = queries.QUERIES[name](spark, folder)
    began = time.time()
    want = con.sql(f"SELECT {', '.join(own.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert time.time() - began < 120
    assert sorted(map(tuple, own.collect()), key=str) == sorted(want, key=str) and len(want) > 50
