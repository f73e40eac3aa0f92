"""Every registered query against its DuckDB oracle at sf0.01 (the driver's correctness gate),
plus the entry smoke check at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from legible.plans import catalog  # noqa: E402
from oracle_check import compare, duck  # noqa: E402


SF001 = "/root/testdata/sf0.01"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_oracle_or_is_declared_rows_only():
    rows_only = {
                 "java_rename_job"}
    missing = set(NAMES) - set(E.oracle_sql()) - rows_only
    assert not missing, missing
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    status, ns, nd, _ = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF001)
    assert status in ("ok", "rows-only"), status
    assert ns is not None and ns >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["source", "n_files", "n_changed", "n_replacements"]
