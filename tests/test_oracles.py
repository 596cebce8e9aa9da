"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from tallyspark.plans.oracles import all_oracles
from tallyspark.plans.queries import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_oracles()
FITS = sorted(set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", FITS)
def test_fit_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_only_fits_lack_sql():
    assert FITS == ["forecast_candidates", "risk_report"]


def test_entry_names_hold_the_queries():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
