import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llm_edges import DIR, EDGE  # noqa: E402


@pytest.fixture(scope="session")
def documents():
    import duckdb
    return duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture()
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, [1]) for i, t in EDGE], "doc_id long, text string, _id string, n long, ids array<int>")


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
