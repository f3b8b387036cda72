"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import normal
from snapledger.workloads import all_workloads
from snapledger.workloads.catalogue import TABLES


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{small}/{table}.parquet')")
    return connection


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {r["status"] for r in entry.entry(spark).collect()} == {"added", "removed", "changed", "same"}


@pytest.mark.parametrize("name", sorted(all_workloads()))
def test_query(spark, con, small, name):
    df = entry.queries()[name](spark, small)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.collect(), df.columns) == normal(result.fetchall(), columns)
