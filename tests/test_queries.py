"""Every query with a SQL counterpart, side by side with DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck
from conftest import SF


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    problem, _ = compare(spark, connection, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["s4_dataset_info", "s11_report_text", "m11_feature_importance"])
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
