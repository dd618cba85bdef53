"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as driver
from tests.compare import differences, duck

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
