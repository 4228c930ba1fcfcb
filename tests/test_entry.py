"""Driver contract: entry, queries and their oracle SQL on sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_compare import compare, duck_conn  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["Id", "generated", "Category", "resolved_by"]


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, name):
    sql = E.oracle_sql().get(name)
    r = compare(spark, name, E.queries()[name], sql, SF, duck_conn(SF), verbose=True)
    if sql is not None:
        assert r["schema"] and r["values"], r
    assert r["rows"] >= 0
