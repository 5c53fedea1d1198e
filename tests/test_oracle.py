"""Every registered query against its DuckDB statement on the same tables."""

import pytest
from conftest import SF_DIR
from oracle_check import compare, tables

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    state, rows, _, detail = compare(spark, con, SF_DIR, name, QUERIES, ORACLES)
    assert state in ("ok", "rows-only"), f"{name}: {state} {detail}"
    assert rows > 0, f"{name} returned nothing"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 30
