"""Every registered query with SQL gives the rows of that SQL, names and types included."""

import pytest

import __spark_entry__ as spark_entry
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_oracles_belong_to_queries():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    problem, _, _ = compare(spark, connection, name, FOLDER)
    assert problem is None


def test_entry(spark):
    rows = {r["split"]: r["rows"] for r in spark_entry.entry(spark).collect()}
    assert rows == {"train": 700, "validation": 150, "holdout": 150}
