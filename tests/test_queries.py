"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import difference, duck
from trustdesk.plans.oracle import ORACLES
from trustdesk.plans.queries import QUERIES



@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert difference(entry.queries()[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry(spark):
    assert "score" in entry.entry(spark).columns
