import pytest
from oracle import compare

from sortweave.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    compare(spark, name, QUERIES[name], ORACLES[name], sf)


def test_generated_sort(spark, sf):
    rows = QUERIES["generated_sort"](spark, sf).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, 5001))
    assert [r.key for r in rows] == sorted(r.key for r in rows)
