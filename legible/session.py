"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "legible",
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Session with AQE on and the UI off; on a cluster ``master`` stays unset."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # no broadcast from planning-time estimates (they can be far off after explode/aggregate);
        # AQE broadcasts a side only after its stage ran and measured below 32 MB
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # whole source files travel through the scanner and prompts through the provider in Arrow
        # batches: keep a batch to a bounded number of rows so a Python worker's memory stays small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only a local-mode
    session (tests, benches) without one gets a fresh scratch folder; on a cluster a missing
    setting is an error, never a silent machine-local fallback."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder setting
        sc = None
    d = spark.conf.get(CHECKPOINT_CONF, None) or (sc.getCheckpointDir() if sc else None)
    if not d:
        master = sc.master if sc else spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):      # not local-cluster: its executors share no folder
            raise RuntimeError("set %s to a folder every executor can reach" % CHECKPOINT_CONF)
        d = tempfile.mkdtemp(prefix="legible-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, d)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint into the shared folder, computing ``df`` once.

    ``Dataset.checkpoint`` would otherwise evaluate the plan twice (once for the eager count,
    once while writing the checkpoint files); a transient persist in between avoids that."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out
