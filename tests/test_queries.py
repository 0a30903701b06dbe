"""Every registered query against its SQL, on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry_module
from harness import oracle
from harness.compare import compare, connect
from harness.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle.QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    build, query = entry_module.queries()[name], oracle.sql(name)
    _, problems = compare(spark, connection, name, build, query, SF_DIR)
    assert problems == []


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 20
