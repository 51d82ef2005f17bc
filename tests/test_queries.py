"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from jobscope.plans import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.01")


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0
    assert "net_amount" in df.columns


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, f"{DATA}/sf0.01"), con, ORACLES[name]) is None


@pytest.fixture(scope="module")
def loaded():
    return connect(f"{DATA}/sf0.001", "TABLE")


@pytest.mark.parametrize("name", list(driver.oracle_sql()))
def test_sql_runs_on_tables_too(loaded, name):
    loaded.sql(driver.oracle_sql()[name]).fetchall()
