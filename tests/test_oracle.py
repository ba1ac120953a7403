"""Every registered query against its DuckDB oracle on the smallest driver tables (the driver's gate)."""

import os

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

SF = os.environ.get("CANOPY_TEST_SF", "/root/testdata/sf0.001")
QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["lvl", "nodes", "leaves"] and rows and rows[0]["lvl"] is None  # the id-0 row


def test_every_query_registered_with_an_id():
    assert len(QUERIES) >= 100 and set(ORACLE) <= set(QUERIES)
    # Without an oracle are only text operators, whose own tests hold them against brute force.
    assert all(n == "pipeline" or n.startswith("op") for n in set(QUERIES) - set(ORACLE))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert r["status"] == "match", r
