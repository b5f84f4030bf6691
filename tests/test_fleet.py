import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows_of, rows_of_sql
from tidewater.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    columns, rows = rows_of(df)
    if QUERIES[name].sql is None:
        assert len(columns) == len(set(columns))
        return
    other, expected = rows_of_sql(con, QUERIES[name].sql)
    assert columns == other
    assert rows == expected
