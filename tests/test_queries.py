"""Every registered query against its SQL twin, or at least non-empty when SQL cannot say it."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from tests.compare import difference, duck

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_the_model_columns(spark):
    df = driver.entry(spark)
    assert df.columns == sorted(df.columns) and len(df.columns) == 18
