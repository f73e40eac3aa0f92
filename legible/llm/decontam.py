"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is in a document when the document holds at least ``percent`` of the item's distinct word shingles.
Comparing whole MinHash signatures would drown a short item in a long document, so the sketch is taken of the
item alone: items are partitioned by size, and an item keeps its ``s`` smallest shingle hashes, s such that
any set holding ``percent`` of the shingles of an item of its size class must hold one of them
(``s = size - ceil(size * percent / 100) + 1`` at the top of the class).  A document is searched only for the
classes it is large enough for; items with a sketch hash among its shingles are candidates, verified by
counting the item's shingles in the document.  The search misses nothing.

Scale: documents never move between tasks; the items go to all tasks in blocks of at most ``BLOCK`` shingles (counted
while they are read), one pass over the documents for each block, however large the benchmark is.  The result of a
block is staged, and its broadcast destroyed, before the next block is sent: a task runs one index, and the driver holds
two blocks and one partition of the items at most.

Edge cases: words are lower-cased (A-Z); null, empty and blank texts hold nothing and items without words
are in nothing; an item shorter than a shingle is one shingle of its own length; items that repeat an id
count as items of their own; empty tables on either side give no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legible.llm.common import forgetting, gram_hashes, stage, text_batches, unstage, word_hashes

#: Shingles of items that are sent to the tasks at once (8 bytes each, and a few times that as Python objects).
BLOCK = 1_000_000


class ItemIndex:
    """Sketches and shingle sets of a block of items, by shingle length and size class."""

    def __init__(self, items: list[tuple[object, bytes]], n: int, percent: int):
        self.percent, self.ids, self.sets, classes = percent, [], [], {}
        h, ends = word_hashes([t for _, t in items], lower=True)
        for (i, _), s, e in zip(items, ends[:-1], ends[1:]):
            if e > s:
                length = min(n, int(e - s))
                found = np.unique(gram_hashes(h[s:e], length))
                classes.setdefault((length, len(found).bit_length()), []).append(len(self.ids))
                self.ids.append(i)
                self.sets.append(found)
        self.classes = []
        for (length, bits), members in sorted(classes.items()):
            top = (1 << bits) - 1
            s = top - math.ceil(top * percent / 100) + 1
            pairs = [(int(x), m) for m in members for x in self.sets[m][:s]]
            pairs.sort()
            keys = np.array([p[0] for p in pairs], np.uint64)
            least = min(math.ceil(len(self.sets[m]) * percent / 100) for m in members)
            self.classes.append((length, least, keys, np.array([p[1] for p in pairs])))

    def search(self, h: np.ndarray) -> list[tuple[int, int]]:
        """Numbers of the items in a text of these word hashes, and how many of their shingles it holds."""
        out, grams = [], {}
        for length, least, keys, members in self.classes:
            if length not in grams:
                grams[length] = np.unique(gram_hashes(h, length))
            g = grams[length]
            if len(g) < least:
                continue
            # the smaller side is looked up in the larger
            if len(keys) < len(g):
                at = np.minimum(np.searchsorted(g, keys), len(g) - 1)
                candidates = members[g[at] == keys]
            else:
                low, high = np.searchsorted(keys, g), np.searchsorted(keys, g, "right")
                candidates = np.concatenate([members[a:b] for a, b in zip(low[high > low], high[high > low])] or [members[:0]])
            for m in np.unique(candidates).tolist():
                s = self.sets[m]
                held = int((g[np.minimum(np.searchsorted(g, s), len(g) - 1)] == s).sum())
                if 100 * held >= self.percent * len(s):
                    out.append((m, held))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """Items with words in blocks of at most ``BLOCK`` words (an upper bound of their shingles), or one item."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        n = len(bytes(r["t"] or b"").split())
        if block and size + n > BLOCK:
            yield block
            block, size = [], 0
        if n:
            block.append((r["i"], bytes(r["t"])))
            size += n
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per input row: ``<id_col>, item_ids`` (sorted array, null ids first), ``n_items, containment`` (largest share of an
    item's shingles found, 0.0 without a hit) and ``contaminated``."""
    spark = docs.sparkSession
    text_batches(spark)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"),
                      F.array().cast(f"array<{items.schema[item_id].dataType.simpleString()}>").alias("found"),
                      F.lit(0.0).alias("best"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)

    def passed(df: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, n, percent)
            for b in batches:
                h, ends = word_hashes(b.column(1).to_pylist(), lower=True)
                found, best = b.column(2).to_pylist(), b.column(3).to_pylist()
                for i in range(b.num_rows):
                    for m, held in index.search(h[ends[i]:ends[i + 1]]):
                        found[i].append(index.ids[m])
                        best[i] = max(best[i], held / len(index.sets[m]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(found, b.column(2).type), pa.array(best, pa.float64())], b.schema.names)

        return df.mapInArrow(forgetting(run), schema)

    shared = staged = None
    for block in _blocks(items, item_id, item_text):
        if shared:  # one block lives at a time
            before, staged = staged, stage(src, "decontam")
            shared.destroy()
            if before:
                unstage(before)
            src = staged
        shared = spark.sparkContext.broadcast(block)
        src = passed(src, shared)
    return src.select(F.col("_id").alias(id_col), F.sort_array("found").alias("item_ids"),
                      F.size("found").cast("long").alias("n_items"), F.col("best").alias("containment"),
                      (F.size("found") > 0).alias("contaminated"))
