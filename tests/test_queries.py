"""Every query against its SQL on the smallest tables, and the entry points."""

import pytest

import __spark_entry__ as entry_points
from compare import compare, connect
from marketloom.plans.catalog import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).columns[:2] == ["date", "ticker"]
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
