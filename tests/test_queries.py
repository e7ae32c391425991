"""Every registered query against its SQL."""

import duckdb
import pytest
from compare import differences, register_tables

import __spark_entry__ as driver

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    register_tables(connection, FOLDER, TABLES)
    return connection


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns[0] == "top_category" and driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, sql, name):
    df = driver.queries()[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    text = driver.oracle_sql().get(name)
    if text is None:
        assert df.count() > 0
    else:
        assert differences(df, sql, text) == []
