"""Every catalogue query against its DuckDB equivalent."""

import pytest

from tests.conftest import SMALL, same_rows
from tidemark.plans import catalogue

SQL = catalogue.oracle_sql()


def test_each_query_has_sql():
    assert set(SQL) == set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    found = catalogue.queries()[name](spark, SMALL).toPandas()
    same_rows(found, duck.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
