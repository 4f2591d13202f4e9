"""The queries of this folder against their SQL twins; those without one are held against brute force next door."""

import pytest

from tests.oracle import assert_same, connect
from trailsift.llm.queries import QUERIES, SQL
from trailsift.session import tune

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert_same(QUERIES[name](tune(spark), SF), connect(SF), SQL[name])


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14)) and set(SQL) <= set(QUERIES)
