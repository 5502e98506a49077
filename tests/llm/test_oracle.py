import pytest

from docweft.llm import oracle, queries
from tests.oracle import connection, difference


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, data, con, name):
    assert difference(con, queries.queries()[name](spark, data), oracle.oracle_sql()[name]) == ""
