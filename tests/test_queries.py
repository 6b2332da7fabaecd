"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
from check import matches

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return connection


def test_all_have_sql():
    assert set(registry._own_queries()) <= set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query(spark, con, name):
    same, note = matches(spark, con, SF, name)
    assert same, note


def test_entry(spark):
    assert registry.entry(spark).count() > 0
