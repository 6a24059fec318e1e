"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessellon.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(names, table):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in at) for r in table)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    assert rows(got.columns, got.collect()) == rows(list(want.columns), want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
