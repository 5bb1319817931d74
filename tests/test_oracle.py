"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, normal

SF = "/root/testdata/sf0.001"
OWN = [n for n, f in entry.queries().items() if n in entry.oracle_sql() and not f.__module__.startswith("tidegrid.llm")]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    got, want = normal(entry.queries()[name](spark, SF).toPandas()), normal(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
