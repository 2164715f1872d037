"""Queries that SQL can express, against it."""

import glob

import duckdb
import pytest

from strataq.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[-1][:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(oracles.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*want.columns).collect())
