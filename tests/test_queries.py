"""Every query of the library against its SQL on the smallest tables."""

import pytest

from sitescope import queries

from .compare import same
from .conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA), duck, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert {"category", "score"} <= set(e.entry(spark).columns)
    assert set(e.oracle_sql()) <= set(e.queries())
