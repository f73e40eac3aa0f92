"""Ordering helpers that stay correct when one group holds a third of all rows.

``dense_seq`` numbers rows 0..n-1 inside each group without sending a whole group to one
task: the table is range-partitioned on (group, order) so a hot group is split over many
partitions, each partition numbers its own slice, and a small per-(partition, group) count
table supplies the offsets.  Only that count table is windowed per group, and it has at most
one row per partition a group touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legible.operators.util import join_nulls
from legible.session import cut_lineage


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def dense_seq(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "seq",
              num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row inside its group, ordered by ``order_cols``.

    ``order_cols`` must be a total order inside a group (ties make the numbering arbitrary).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(group_cols)
    # written once: range bounds are sampled anew by every plan that holds the exchange, so the counts and
    # the rows must read one and the same partitioning
    ranged = cut_lineage(df.repartitionByRange(n, *_cols(keys + list(order_cols))).withColumn(
        "_pid", F.spark_partition_id()))
    # numbering inside one range partition: a (partition, group) piece is bounded by the partition size
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*_cols(order_cols))) - 1)
    counts = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (join_nulls(local, offsets.select("_pid", *keys, "_off"), ["_pid", *keys])
                 .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
                 .drop("_pid", "_local", "_off"))


def fixed_slices(df: DataFrame, group_cols: list[str], order_cols: list, size: int,
                 out: str = "slice_no") -> DataFrame:
    """Consecutive chunks of ``size`` rows per group (12 docs, 100 folders, 300 files)."""
    seq = dense_seq(df, group_cols, order_cols, out="_seq")
    return seq.withColumn(out, F.floor(F.col("_seq") / F.lit(size)).cast("bigint")).drop("_seq")


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list, k: int,
                    salt_buckets: int | None = None, out: str = "rk") -> DataFrame:
    """First ``k`` rows per group by ``order_cols`` (rank in ``out``), skew-safe.

    Stage 1 keeps the first k rows of every (group, salt) piece, so a hot group is cut into
    ``salt_buckets`` independent sorts; stage 2 ranks at most ``salt_buckets * k`` rows per group."""
    spark = df.sparkSession
    b = salt_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*_cols(order_cols)), F.lit(b)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*_cols(order_cols))
    pre = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*_cols(order_cols))
    return pre.withColumn(out, F.row_number().over(w2) - 1).filter(F.col(out) < k)
