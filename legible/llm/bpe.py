"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For every prefix of a byte string, the BPE encoding of that prefix ends in one unique token; the encoding of
the whole is found by following these last tokens back.  The last token of prefix ``i`` is the only token
``t`` that ends there and whose left neighbour (the last token of the prefix before ``t``) may stand next to
it, i.e. for which BPE would not have merged across the border.  Appending bytes only adds entries, and
after an edit entries are recomputed from the edit until they agree with the old ones again.

In Spark: texts stay in their partitions (no shuffle); the vocabulary (a fixed file of about 50,000 entries)
is read on the driver and broadcast; each match of the pre-tokenisation pattern is encoded on its own.

Edge cases: null text is the empty text with no ids; texts of any length are whole; repeated rows and null
ids pass through row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legible.llm.common import text_batches
from legible.llm.units import process_memo


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Vocabulary:
    """Token tables: bytes -> rank, and for every token the two tokens its last merge joined."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        self.parts: list[tuple[int, int]] = []
        self.joined: dict[tuple[int, int], int] = {}
        for i, t in enumerate(tokens):
            pair = self._last_merge(t, i) if len(t) > 1 else (i, i)
            self.parts.append(pair)
            if len(t) > 1:
                self.joined[pair] = i
        self.fits = lru_cache(1 << 17)(self._fits)

    def last_token(self, data: bytes, last, i: int) -> int:
        """Last token of prefix ``i`` (``i >= 1``), given those of all shorter prefixes: the only token that ends
        there and may follow the last token of the prefix before it."""
        rank, fits, j = self.rank.get, self.fits, i - 1
        low = max(0, i - self.longest)
        while j >= low:
            t = rank(data[j:i])
            if t is not None and (j == 0 or fits(last[j], t)):
                return t
            j -= 1
        raise ValueError("a byte has no token")

    def back(self, data: bytes, last) -> list[int]:
        """Follow the last tokens from the end."""
        out, i, tokens = [], len(data), self.tokens
        while i:
            out.append(last[i])
            i -= len(tokens[last[i]])
        return out[::-1]

    def _last_merge(self, token: bytes, below: int) -> tuple[int, int]:
        """The two tokens left when every merge of a rank under ``below`` has been made in ``token``."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], below))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left right`` side by side: undo both tokens' merges from the last to the first and
        see whether a merge across the border would have come before the one undone."""
        before = len(self.tokens) + 1
        while True:
            if self.joined.get((left, right), before) < before:
                return False
            a, b = self.parts[left], self.parts[right]
            inner_left, inner_right = a[0] != left, b[0] != right
            if not inner_left and not inner_right:
                return True
            # the later merge is undone first; between equal tokens BPE merges the left one first
            if inner_left and (left > right or not inner_right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]


class PrefixTable:
    """Last tokens of all prefixes of one byte string; ``append`` and ``replace`` keep it exact."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", array("i", [-1])
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data) + 1
        self.data += more
        for i in range(start, len(self.data) + 1):
            self.last.append(self.vocab.last_token(self.data, self.last, i))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` for bytes ``start:end``; returns how many entries were computed anew."""
        old, shift = self.last, start + len(new) - end
        data = self.data[:start] + new + self.data[end:]
        last = old[:start + 1]
        same, i = 0, start + 1
        while i <= len(data):
            last.append(self.vocab.last_token(data, last, i))
            # a full longest-token length of unchanged entries after the edit: all later ones are unchanged too
            same = same + 1 if i > start + len(new) and last[i] == old[i - shift] else 0
            if same >= self.vocab.longest and i - start - len(new) >= 2 * self.vocab.longest:
                last.extend(old[i - shift + 1:])
                break
            i += 1
        self.data, self.last = data, last
        return min(i, len(data)) - start

    def ids(self) -> list[int]:
        return self.vocab.back(self.data, self.last)


def encode_bytes(vocab: Vocabulary, data: bytes) -> list[int]:
    """ids of one match of the pattern."""
    whole = vocab.rank.get(data)
    if whole is not None:
        return [whole]
    last, find = [-1], vocab.last_token
    for i in range(1, len(data) + 1):
        last.append(find(data, last, i))
    return vocab.back(data, last)


def _encoder(tokens: list[bytes], pattern: str):
    """Texts -> id bytes of every text, each match of the pattern on its own."""
    vocab, match = Vocabulary(tokens), regex.compile(pattern)

    def run(texts: list[str]) -> list[bytes]:
        return [array("I", [i for m in match.findall(t) for i in encode_bytes(vocab, m.encode())]).tobytes() for t in texts]
    run.forget = vocab.fits.cache_clear
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids array<int>``: one row per input row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    text_batches(spark, 800)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = process_memo(shared.value, pattern, _encoder)
        for b in batches:
            flat, ends = memo.ids([t or b"" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), id_lists(flat, ends)], ["_id", "ids"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def id_lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """ids of the rows of a batch as one Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` binary: the bytes of the ids.  All other columns pass through; null ids give no bytes."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    keep = [c for c in encoded.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.array(shared.value, object)
        for b in batches:
            lists = b.column(keep.index(ids_col))
            found, ends = tokens[lists.values.to_numpy()], lists.offsets.to_numpy()
            made = [b"".join(found[s:e].tolist()) for s, e in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*keep, out_col])

    src = encoded.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + f", `{out_col}` binary"
    return src.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids array<int>, decodes boolean``: the ids and whether their bytes are the text (null: empty), in one pass."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    text_batches(spark, 800)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, tokens = process_memo(shared.value, pattern, _encoder), np.array(shared.value, object)
        try:
            for b in batches:
                texts = [t or b"" for t in b.column(1).to_pylist()]
                flat, ends = memo.ids(texts)
                same = [b"".join(tokens[flat[s:e]].tolist()) == t for t, s, e in zip(texts, ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), id_lists(flat, ends), pa.array(same, pa.bool_())], ["_id", "ids", "decodes"])
        finally:    # tasks go round all idle processes of an executor: only those at work remember units
            memo.forget()
            pa.default_memory_pool().release_unused()

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids array<int>, decodes boolean").withColumnRenamed("_id", id_col)
