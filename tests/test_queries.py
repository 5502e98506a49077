import pytest

import __spark_entry__
from docweft.plans import catalogue
from tests.oracle import connection, difference


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, data, con, name):
    df = catalogue.queries()[name](spark, data)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert difference(con, df, sql) == ""


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_is_for_known_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
