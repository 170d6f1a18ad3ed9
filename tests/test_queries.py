import pytest

from quillspan.plans.queries import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])
