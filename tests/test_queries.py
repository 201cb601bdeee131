"""Every registered query against its SQL, value for value."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import compare, duck
from tests.conftest import SF_DIR

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert compare(QUERIES[name](spark, SF_DIR), connection, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) - set(entry_points.TEXT_QUERIES) <= set(SQL) <= set(QUERIES)


def test_entry_gives_hours(spark):
    df = entry_points.entry(spark)
    assert "avg_temp" in df.columns
    assert df.count() > 0
