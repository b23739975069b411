"""The queries that SQL can express against it, over the whole small tables."""

import pytest
from compare import difference, oracle
from vecflow.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert difference(queries.queries()[name](spark, SMALL), oracle(SMALL), queries.oracle_sql()[name]) is None
