"""Every registered query against its SQL twin on the smallest test data."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck
from webtables.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    ok, message, _ = compare(spark, con, SF, QUERIES[key], TWINS.get(key))
    assert ok, message


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "src", "dst"]
