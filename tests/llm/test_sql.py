"""The queries that SQL can express, against it; every query on the smallest tables."""

import glob
import os

import duckdb
import pytest

from stratadoc.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sql, name):
    out = queries.QUERIES[name](spark, SF)
    want = sql.sql(queries.ORACLE_SQL[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in out.collect())
    assert rows == sorted(str(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
