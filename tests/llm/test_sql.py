"""Queries that SQL can express against their DuckDB statement."""
import duckdb
import pytest

from quarry.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op5_quality_rules"])
def test_query_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, sf)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
