"""Every registered query against its SQL text on the smallest test tables."""

import os

import duckdb
import pytest

import check
from firmatlas.checks import registered_queries, registered_sql

FOLDER = os.environ.get("REGISTERED_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(registered_queries()) == set(registered_sql())


@pytest.mark.parametrize("name", sorted(registered_queries()))
def test_query(spark, con, name):
    df = registered_queries()[name](spark, FOLDER)
    result = con.execute(registered_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = check.sorted_rows(columns, result.fetchall())
    assert check.sorted_rows(df.columns, df.collect()) == expected
