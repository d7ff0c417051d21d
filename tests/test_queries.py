"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_sql_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_rows_and_stable_schema(spark):
    first, second = driver.entry(spark), driver.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0
