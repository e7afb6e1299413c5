"""Training-data queries against their SQL, on the smallest tables."""

import pytest

from orrery.llm.queries import oracle_sql, queries
from tests.compare import assert_equal, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_equal(queries()[name](spark, SF).toPandas(), connect(SF).execute(oracle_sql()[name]).df())
