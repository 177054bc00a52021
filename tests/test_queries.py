"""Every registered query against its SQL statement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_statement_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


def test_comparison_sees_differences(spark, con):
    sql = ORACLES["content_counts"]
    assert compare(spark, con, FOLDER, QUERIES["content_counts"], sql + " WHERE doc_id > 0") is not None
    assert compare(spark, con, FOLDER, QUERIES["content_counts"], sql.replace("AS char_count", "+ 1 AS char_count")) is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
