"""Token ids as Parquet list columns that can be read selectively.

File format: a folder of Parquet files, one per range of ids in ascending order, rows in ascending id order.
Columns: the document's id, ``part`` (range number), ``part_start`` (ids before it in its part), ``n_tokens``
and ``ids`` (list of ints, end id included).  ``ids`` is dictionary-encoded (a vocabulary is at most some
ten thousand values); the ascending or small numbers are delta-encoded (format version 2).  Row groups and
pages are kept small and page indexes are written, so a reader that filters on the id touches few pages and
one that wants numbers only never reads the lists.

Scale: texts are range-partitioned once, encoded where they land, and written from there; a document's
position in the whole is its part's offset (one row per part) plus ``part_start``.

Edge cases: null text is the empty text (end id only); null ids sort first; rows with equal ids are in text
order, so each has its own place; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from legible.llm.bpe import id_lists
from legible.llm.common import partitions, shared_dir, text_batches
from legible.llm.units import plain, process_memo

#: New units that are encoded in one string.
JOINED = 50
#: Bytes of a row group and rows of a page: what one selective read has to touch at least.
ROW_GROUP, PAGE_ROWS = 16 << 20, 200


def _library(description: str, _: str):
    """Texts -> id bytes of every text by the tokenizers library; its special strings are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_str(description)
    tok.encode_special_tokens = True
    tok.no_truncation()
    tok.no_padding()
    size = tok.get_vocab_size(with_added_tokens=True)
    blank = np.array([(tok.id_to_token(i) or "").startswith("\u0120") for i in range(size)])  # how byte-level files write a blank

    def each(units: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(units, add_special_tokens=False)]

    def encode(units: list[str]) -> list[bytes]:
        # units of one blank and a word are encoded many in a string: their ids part again where a token begins with a blank
        inline = [u for u in units if plain(u)]
        rows = [inline[i:i + JOINED] for i in range(0, len(inline), JOINED)]
        known = {}
        for us, e in zip(rows, tok.encode_batch_fast(["".join(us) for us in rows], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = [*(np.flatnonzero(blank[ids]) * 4).tolist(), len(ids) * 4]
            data = ids.tobytes()
            if len(cuts) == len(us) + 1:
                known.update(zip(us, [data[s:e] for s, e in zip(cuts, cuts[1:])]))
        other = [u for u in units if u not in known]
        known.update(zip(other, each(other)))
        return [known[u] for u in units]

    return encode


def encode_with_library(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int | None) -> DataFrame:
    """Rows of range-partitioned, sorted ``docs`` as ``_id, part, part_start, n_tokens, ids``.

    The tokenizers library encodes every distinct unit of a task once (see ``units``); strings of special
    tokens inside a text are ordinary text."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, done = process_memo(shared.value, "library", _library), TaskContext.get().partitionId(), 0
        for b in batches:
            flat, ends = memo.ids([t or b"" for t in b.column(1).to_pylist()], end)
            n = np.diff(ends)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(done + ends[:-1]), pa.array(n), id_lists(flat, ends)],
                ["_id", "part", "part_start", "n_tokens", "ids"])
            done += int(ends[-1])
        pa.default_memory_pool().release_unused()

    text_batches(spark, 2000)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    ranged = src.repartitionByRange(partitions(spark), "_id").sortWithinPartitions("_id", "_text")
    numbers = T.StructType.fromDDL(f"_id {kind}, part bigint, part_start bigint, n_tokens bigint")
    return ranged.mapInArrow(run, numbers.add("ids", T.ArrayType(T.IntegerType(), False)))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int | None = 0) -> None:
    """Encode ``docs`` and write the files of the format to ``path`` (any store Spark can write)."""
    out = encode_with_library(docs, tokenizer_path, id_col, text_col, end_id).withColumnRenamed("_id", id_col)
    w = out.write.option("compression", "snappy").option("parquet.writer.version", "PARQUET_2_0")
    w = w.option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", PAGE_ROWS)
    for c in (id_col, "part", "part_start", "n_tokens"):
        w = w.option(f"parquet.enable.dictionary#{c}", "false")
    # lists without nulls as repeated values in place of groups: one call of the writer per id, not five
    form = "spark.sql.parquet.writeLegacyFormat"
    before = docs.sparkSession.conf.get(form)
    docs.sparkSession.conf.set(form, "true")
    try:
        w.parquet(path)
    finally:
        docs.sparkSession.conf.set(form, before)


def read_tokens(spark: SparkSession, path: str, *cols: str, where=None) -> DataFrame:
    """Rows of the files plus ``start`` (ids of all documents before).  ``where`` (on the id) is pushed to the pages;
    without ``ids`` among ``cols`` the lists are not read."""
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # one row per part (file), so this window and broadcast are bounded by the number of files
    offsets = sums.select("part", F.coalesce(F.sum("_n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    if where is not None:
        rows = rows.filter(where)
    full = rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("_off") + F.col("part_start")).drop("_off")
    return full.select(*cols) if cols else full


def id_crc32(tokens: DataFrame, ids_col: str = "ids", out_col: str = "ids_crc32") -> DataFrame:
    """Replaces the list by the unsigned crc32 of its ids as little-endian unsigned 32-bit integers."""
    keep = [c for c in tokens.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keep))
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], [*keep, out_col])

    src = tokens.select(*keep, ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != ids_col)
    return src.mapInArrow(run, f"{schema}, `{out_col}` bigint")


def new_token_path(spark: SparkSession) -> str:
    """A fresh folder below the session's shared folder."""
    return f"{shared_dir(spark)}/llm/tokens-{uuid.uuid4().hex}"
