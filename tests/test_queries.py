import pytest

from postlake import oracles, views  # noqa: F401  register more queries and SQL
from postlake.queries import ORACLES, QUERIES
from tests.helpers import DATA, same_as_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_sql(spark, name):
    same_as_sql(spark, QUERIES[name], ORACLES[name], "sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
