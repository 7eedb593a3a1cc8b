"""Every registered query against its SQL twin on the smallest test tables."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from fleetlens.catalog import oracle
from fleetlens.catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 25 and "needs_rebalancing" in df.columns
