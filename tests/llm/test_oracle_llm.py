"""Queries with SQL against DuckDB on the whole tables at sf0.01."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

from legible.llm.queries import oracle_sql, queries  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    status, n, _, _ = compare(spark, con, name, queries()[name], oracle_sql()[name], SF001)
    assert status == "ok", status
    assert n
