"""Helpers shared by the training-data operators.

Conventions of every operator in this package:

* a *word* is a maximal run of ``[^\\x20\\x09-\\x0D]``, unchanged unless an operator says lower-cased (A-Z only);
* an operator selects the id and text columns it needs first, so extra columns of any name are harmless;
* a null text counts as no words / an empty string, a null id is an ordinary (smallest) id value;
* rows that repeat (same id, same text) each get their own result row.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A whole table, pruned to ``cols`` at the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def words(text: Column) -> Column:
    """Words of a text column as an array (JVM only); null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), lambda x: x != "")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a scratch folder is set only where it is unset (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = tempfile.mkdtemp(prefix="legible-llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: cuts lineage, survives executor loss,
    and computes the plan a single time (``checkpoint()`` computes it twice)."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/llm/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the written table replaces the shuffle files: they go with the query
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def stage_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like ``stage``, but bucketed by ``key``: joins on it move the other side only.

    Such a side is not split at run time, so join it only with rows that have no hot ``key``; ``plain`` reads the
    same files without buckets."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    path, n = f"{shared_dir(spark)}/llm/{name}", partitions(spark)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.stage_path, out.stage_name = path, name
    return out


def plain(table: DataFrame) -> DataFrame:
    """A staged table without its buckets."""
    return table.sparkSession.read.schema(table.schema).parquet(table.stage_path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no plan reads any more."""
    for t in tables:
        if hasattr(t, "stage_name"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.stage_name}")
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.stage_path)
        path.getFileSystem(conf).delete(path, True)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small: Python memory is a few batches, whatever the table size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- vectorised word hashing (inside tasks)

_MEMO: dict[bytes, int] = {}
_MEMO_MAX = 1 << 20


def word_hashes(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch and the word offsets of its texts (length ``len(texts) + 1``).

    ``bytes.split`` splits on exactly ``\\x20\\x09-\\x0D`` and ``bytes.lower`` changes exactly A-Z."""
    memo, get = _MEMO, _MEMO.get
    if len(memo) > _MEMO_MAX:
        memo.clear()
    flat: list[int] = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            ws = (t.lower() if lower else t).split()
            try:
                flat.extend(map(memo.__getitem__, ws))
            except KeyError:
                del flat[offsets[i]:]
                for w in ws:
                    h = get(w)
                    if h is None:
                        h = memo[w] = xxhash.xxh3_64_intdigest(w)
                    flat.append(h)
        offsets[i + 1] = len(flat)
    return np.array(flat, np.uint64), offsets


def forgetting(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; when the task ends its process forgets its words, so idle workers stay small."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _MEMO.clear()
            pa.default_memory_pool().release_unused()
    return task


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array (wrapping arithmetic)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every ``n`` consecutive word hashes (``len(h) - n + 1`` values; empty if shorter)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for i in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + mix(h[i:i + m] + np.uint64(i))
    return mix(acc)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingle hashes; fewer than ``n`` words: the whole sequence as one; none: empty."""
    if len(h) == 0:
        return h
    return np.unique(gram_hashes(h, min(n, len(h))))
