"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from compare import connect, differ
from winnow.plans.oracles import ORACLES
from winnow.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    assert differ(entry.queries()[name](spark, sf), duck, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)
