import pytest

from quern.plans import registry
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    check(QUERIES[name](spark, sf), con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
