"""Driver-table access: one parquet file per table, columns pruned at the scan."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``; selecting ``cols`` here lets Catalyst prune the scan.

    A scan that yields fewer splits than the cluster has cores (a small file with a single row
    group) is hash-partitioned on its first column (the table key) right after pruning, so the text
    work runs on every core and per-key aggregations and joins downstream need no second shuffle of
    the text.  At cluster scale a table has far more splits than cores and nothing is added."""
    df = spark.read.parquet(os.path.join(sf_dir, name + ".parquet"))
    if cols:
        df = df.select(*cols)
    try:
        cores = spark.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without an RDD view (Spark Connect): keep the scan as is
        return df
    if splits < cores:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        key = df.columns[0]
        # hash on the table key (same count as the shuffle partitions, so later aggregations and
        # joins on it reuse the partitioning); without a key column a round-robin split suffices
        df = df.repartition(n, key) if key.endswith("_id") else df.repartition(n)
    return df
