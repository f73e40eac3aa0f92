"""Substring dedup by super-k-mers.

A window is ``size`` consecutive words of one document; a word goes if some window that covers it also starts
earlier (smaller id, or the same document at an earlier word).  Windows are judged on the input.

*Super-k-mers.*  The minimiser of a window is the smallest hash among its ``gram``-word sequences.  Consecutive
windows that share a minimiser occurrence travel together: as one string of their words to the minimiser's bucket.
Equal windows have equal minimisers, so a bucket sees all of them.

*Plan.*  (1) Each document's runs of windows with their minimiser, numbers only; runs whose minimiser occurs
once in the corpus cannot repeat and go no further.  (2) The others' strings are cut from the texts; equal
strings of a task are sent once, with the list of their places.  (3) In a bucket the strings are opened into
windows and all but the first place of each window are marked.  A minimiser with more than ``HOT`` runs
(a passage in a large share of the corpus) is not kept together: its windows are dealt out singly by their own
hash, in order of their first place, so that a bucket never holds more than ``HOT`` runs and a single window is
judged while streaming.  (4) Marks go back to their documents.

Edge cases: null texts have no words; texts shorter than a window are kept whole; null ids sort first; rows
that repeat id and text are one document's copies (same places, not "earlier"); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legible.llm.common import gram_hashes, partitions, text_batches, word_hashes

#: Words of the sequences that compete for a window's minimiser.
GRAM = 6
#: Runs of one minimiser that may meet in one bucket.
HOT = 2000


def runs(h: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's word hashes and text offsets: text number, first window, number of windows and minimiser of
    every run of consecutive windows with one minimiser occurrence."""
    m = len(h) - size + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    g = gram_hashes(h, gram)
    best, at = g[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, size - gram + 1):  # the leftmost smallest: a function of the window's words alone
        lower = g[j:j + m] < best
        best[lower] = g[j:j + m][lower]
        at[lower] = j
    at += np.arange(m)
    valid = text[:m] == text[size - 1:]
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (text[1:m] != text[:m - 1])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    count = np.bincount(group[valid], minlength=len(start))
    of = text[start]
    return of, start - ends[of], count, best[start]


class _Marks:
    """Marked places of an output batch: (id, first window and text key, windows)."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.rows = kind, []

    def add(self, place: tuple, first: int, count: int) -> None:
        self.rows.append((place[0], place[2] + first << 32 | place[1], count))

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [(), (), ()]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(cols[0], self.kind), *(pa.array(c, pa.int64()) for c in cols[1:])],
                                          ["_id", "at", "c"])


def _order(place: tuple) -> tuple:
    """Sort key of a place: null ids first, then id and word; the text key does not make a place earlier."""
    return (place[0] is not None, place[0] if place[0] is not None else 0, place[2])


def _mark_bucket(rows: list[tuple[bytes, list[tuple]]], size: int, marks: _Marks) -> None:
    """rows: (string, its places in order).  Marks every window occurrence but the first of each window."""
    first: dict[bytes, tuple] = {}
    opened = []
    for string, places in rows:
        words = string.split(b" ")
        windows = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]
        known, _, start = low = _order(places[0])
        for i, w in enumerate(windows):
            here = (low[0], low[1], start + i)
            if first.setdefault(w, here) > here:
                first[w] = here
        opened.append((windows, places))
    for windows, places in opened:
        low = _order(places[0])
        for p in places:
            key = _order(p)
            if key != low:
                marks.add(p, 0, len(windows))
                continue
            late = [first[w] != (key[0], key[1], key[2] + i) for i, w in enumerate(windows)]
            i = 0
            while i < len(late):
                if late[i]:
                    j = i
                    while j < len(late) and late[j]:
                        j += 1
                    marks.add(p, i, j - i)
                    i = j
                i += 1


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20,
                    gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per input row: ``<id_col>, n_words, n_removed, kept`` (kept words joined by one blank)."""
    spark = docs.sparkSession
    text_batches(spark)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    n_parts = partitions(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, start, count, low = runs(*word_hashes(b.column(1).to_pylist()), size, gram)
            order = np.argsort(low, kind="stable")  # one row a minimiser and batch, with its further places as lists
            of, place, low = of[order], (start * (size + 1) + count)[order], low[order]
            first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
            many = np.diff(np.append(first, len(low)))
            rest = np.ones(len(low), bool)
            rest[first] = False
            ends = pa.array(np.concatenate([[0], np.cumsum(many - 1)]).astype(np.int32), mask=np.append(many == 1, False))
            ids = b.column(0).take(pa.array(of))
            yield pa.RecordBatch.from_arrays(
                [pa.array(low[first].view(np.int64)), pa.array(many), ids.take(pa.array(first)), pa.array(place[first]),
                 pa.ListArray.from_arrays(ends, ids.filter(pa.array(rest))), pa.ListArray.from_arrays(ends, pa.array(place[rest]))],
                ["mini", "n", "_id", "sc", "ids", "scs"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[int, bytes], list[tuple]] = {}
            single: dict[tuple[int, bytes], list[tuple]] = {}
            for i, text, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words, k = (text or b"").split(), xxhash.xxh32_intdigest(text or b"")
                for r in rs:
                    s, c = divmod(r["sc"], size + 1)
                    if s + c + size - 1 > len(words):
                        continue  # a run of another text under the same id
                    if r["hot"]:
                        for j in range(s, s + c):
                            w = b" ".join(words[j:j + size])
                            single.setdefault((xxhash.xxh3_64_intdigest(w) >> 1, w), []).append((i, k, j))
                    else:
                        found.setdefault((r["mini"], b" ".join(words[s:s + c + size - 1])), []).append((i, k, s))
            rows = [(key, hot_row, string, sorted(set(places), key=lambda p: (_order(p), p[1])))
                    for d, hot_row in ((found, False), (single, True)) for (key, string), places in d.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
                 pa.array([r[2] for r in rows], pa.binary()), pa.array([[p[0] for p in r[3]] for r in rows], pa.list_(b.column(0).type)),
                 pa.array([[p[2] << 32 | p[1] for p in r[3]] for r in rows], pa.list_(pa.int64()))], ["key", "hot", "string", "ids", "at"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket, judged, marks = None, [], {}, None
        for b in batches:
            if marks is None:
                marks = _Marks(b.column(3).type.value_type)
            for key, single, string, ids, ats in zip(*(c.to_pylist() for c in b.columns)):
                if (key, single) != at:
                    _mark_bucket(bucket, size, marks)
                    at, bucket, judged = (key, single), [], {}
                places = [(i, a & 0xFFFFFFFF, a >> 32) for i, a in zip(ids, ats)]
                if not single:
                    bucket.append((string, places))
                    continue
                # rows come in order of their first place: the first row of a window has the first place of all
                low = judged.setdefault(string, _order(places[0]))
                for p in places:
                    if _order(p) != low:
                        marks.add(p, 0, 1)
            if len(marks.rows) > 50_000:
                yield marks.batch()
        if marks is not None:
            _mark_bucket(bucket, size, marks)
            yield marks.batch()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ms in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = (text or b"").split()
                if ms:
                    k, gone = xxhash.xxh32_intdigest(text or b""), np.zeros(len(words) + 1, np.int64)
                    for m in ms:
                        s, end = m["at"] >> 32, (m["at"] >> 32) + m["c"] + size - 1
                        if m["at"] & 0xFFFFFFFF == k and end <= len(words):
                            gone[s] += 1
                            gone[end] -= 1
                    keep = np.cumsum(gone[:-1]) == 0
                    out.append((len(words), int(len(words) - keep.sum()), b" ".join([w for w, x in zip(words, keep.tolist()) if x])))
                else:
                    out.append((len(words), 0, b" ".join(words)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.binary())], ["_id", "n_words", "n_removed", "kept"])

    twice = (src.mapInArrow(scan, f"mini bigint, n bigint, _id {kind}, sc bigint, ids array<{kind}>, scs array<bigint>")
             .repartition(n_parts, "mini").withColumn("m", F.sum("n").over(Window.partitionBy("mini"))).filter("m > 1"))
    own = F.array(F.struct(F.col("_id").alias("id"), F.col("sc").alias("sc")))
    more = F.transform(F.coalesce("ids", F.array()), lambda x, i: F.struct(x.alias("id"), F.get("scs", i).alias("sc")))
    twice = twice.select("mini", "m", F.explode(F.concat(own, more)).alias("p"))
    of_doc = twice.groupBy(F.col("p.id").alias("_of")).agg(
        F.collect_list(F.struct(F.col("p.sc").alias("sc"), "mini", (F.col("m") > hot).alias("hot"))).alias("rs"))
    strings = src.join(of_doc, src["_id"].eqNullSafe(of_doc["_of"])).select("_id", "_text", "rs").mapInArrow(
        pack, f"key bigint, hot boolean, string binary, ids array<{kind}>, at array<bigint>")
    marks = (strings.repartition(n_parts, "key")
             .sortWithinPartitions("key", "hot", F.col("ids")[0].asc_nulls_first(), F.col("at")[0])
             .mapInArrow(mark, f"_id {kind}, at bigint, c bigint"))
    by_doc = marks.groupBy(F.col("_id").alias("_of")).agg(F.collect_list(F.struct("at", "c")).alias("ms"))
    out = src.join(by_doc, src["_id"].eqNullSafe(by_doc["_of"]), "left").select("_id", "_text", "ms").mapInArrow(
        cut, f"_id {kind}, n_words bigint, n_removed bigint, kept binary")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
