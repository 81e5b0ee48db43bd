"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLOW = {"boosted_tree_forecast", "learned_summary", "learned_importances"}


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, folder, connection, name):
    verdict, _, detail = compare(spark, folder, name, QUERIES[name], ORACLES.get(name), connection)
    assert verdict in ("ok", "rows"), detail


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
