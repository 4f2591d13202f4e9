"""Every registered query against its SQL twin; without one, it must give rows twice the same."""

import pytest

import __spark_entry__ as driver
from tests.oracle import assert_same, connect, rows_of
from trailsift.cases import QUERIES as CASES

SF = "/root/testdata/sf0.001"
# The optional queries have tests of their own.
QUERIES = {name: fn for name, fn in driver.queries().items() if name in CASES}
SQL = {name: sql for name, sql in driver.oracle_sql().items() if name in CASES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_is_deterministic(spark, name):
    first = QUERIES[name](spark, SF)
    assert rows_of(first.columns, first.collect()) == rows_of(first.columns, QUERIES[name](spark, SF).collect())


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
