"""Small planning helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def join_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the left side's key columns stay."""
    r = right.withColumnsRenamed({k: "_right_" + k for k in keys})
    on = [left[k].eqNullSafe(r["_right_" + k]) for k in keys]
    return left.join(r, on, how).drop(*["_right_" + k for k in keys])


def bounded_rows(df: DataFrame, limit: int) -> int:
    """Exact row count if it is <= ``limit``, else ``limit + 1`` (never scans past the bound)."""
    return df.limit(limit + 1).count()


def sized_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Mark a side table for broadcast only behind a checked size.

    By default the check is AQE's: the side is planned as a shuffle join, and once its stage has
    run, AQE converts the join to a broadcast hash join only if the measured size is below
    ``spark.sql.adaptive.autoBroadcastJoinThreshold`` (and splits skewed partitions otherwise).
    No extra job runs at planning time.  With ``max_rows`` an explicit bounded row probe decides
    up front (one ``limit(max_rows + 1)`` job)."""
    if max_rows is None:
        return df
    return F.broadcast(df) if bounded_rows(df, max_rows) <= max_rows else df


def bounded_collect(df: DataFrame, max_rows: int):
    """Collect at most ``max_rows`` rows; ``None`` when the table is larger (caller must fall back)."""
    rows = df.limit(max_rows + 1).collect()
    return None if len(rows) > max_rows else rows


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keep Arrow batches of whole texts small: a Python worker holds one of them, however many rows its partition has."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
