"""Every engine query against its SQL, at the smallest scale."""

import pytest
from compare import check, connect

from tidelog.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    check(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_the_same_rows_again(spark, name):
    query = catalog.queries()[name]
    first, again = (sorted(map(tuple, query(spark, SF).collect())) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
