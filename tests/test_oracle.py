import pytest
from oracle import compare, connection

from scoretables import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, con, sf, name):
    compare(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], sf)


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
