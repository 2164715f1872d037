"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import math

import duckdb
import pytest

from strataq import plans

QUERIES, ORACLES = plans.queries(), plans.oracles()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[-1][:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    if name not in ORACLES:
        assert len(rows) > 0 and columns and len(set(rows)) == len(rows)  # each such query has an operator test besides
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "pos", "chunk_id", "content"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
