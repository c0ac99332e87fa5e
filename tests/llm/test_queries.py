import pytest

from sitescope.llm import queries

from ..compare import same
from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA), duck, queries.SQL[name])


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
