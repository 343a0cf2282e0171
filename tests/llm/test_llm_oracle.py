import pytest
from oracle import compare, connection

from scoretables.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    compare(spark, connection(sf), queries.QUERIES[name], queries.ORACLE_SQL[name], sf)
