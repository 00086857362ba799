import pytest
from oracle import compare

from sortweave.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    compare(spark, name, QUERIES[name], ORACLES[name], sf)
