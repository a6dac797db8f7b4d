import pytest

from kestrelgrid.llm.queries import ORACLES, QUERIES

from ..oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])
