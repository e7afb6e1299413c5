"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from orrery.plans.registry import ORACLES, QUERIES
from tests.compare import assert_equal, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_equal(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
