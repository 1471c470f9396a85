"""Every registered query of the library against its SQL, or at least that it gives rows."""

import pytest
from conftest import SF
from helpers import assert_same

from corpusloom.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert_same(got, duck.execute(SQL[name]).df())
    else:
        assert len(got)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
