"""Fill-in-the-middle transformation (op 12).

A text's UTF-8 bytes are cut into fixed blocks.  A Fenwick tree over the blocks holds how many units and how many
code points start in each; a cut "after k units" is found by binary-lifting descent to its block, and only that
block is looked into.  Units are code points, or the stretches that a pattern matches from left to right.

Edge cases: a null text is empty; an empty text and one that holds a sentinel stay plain; a null id draws as the
empty string; rows that repeat are each transformed, all alike; extra columns are not read; an empty table gives none.
A very long text costs its own bytes and two counters for each block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096                    # bytes of text in one block of the tree
OUT_BYTES = 8 << 20             # output bytes that make up one Arrow batch
SENTINELS = ("<P>", "<S>", "<M>")


def draws(seed: str, key: str) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of ``seed:key`` as unsigned integers."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


class BlockTree:
    """Fenwick tree of the (unit, code point) starts in each block of one text."""

    def __init__(self, raw: bytes, unit: re.Pattern | None = None, block: int = BLOCK):
        self.raw, self.unit, self.block = raw, unit, block
        self.lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        n_blocks = max(1, -(-len(raw) // block))
        counts = np.zeros((n_blocks, 2), np.int64)
        if raw:
            counts[:, 1] = np.add.reduceat(self.lead, np.arange(0, len(raw), block), dtype=np.int64)
        if unit is None:
            counts[:, 0] = counts[:, 1]
        else:
            self.first = np.full(n_blocks, -1, np.int64)          # where the first unit of each block starts
            for at in self._starts(0):
                b = at // block
                counts[b, 0] += 1
                if self.first[b] < 0:
                    self.first[b] = at
        total = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(counts, axis=0)])
        i = np.arange(n_blocks + 1)
        self.tree = total - total[i - (i & -i)]                   # node i holds blocks i - lowbit(i) .. i - 1
        self.n_units, self.n_points = map(int, total[-1])
        self.top = 1 << (n_blocks.bit_length() - 1)

    def _starts(self, at: int) -> Iterator[int]:
        """Unit starts from ``at`` on; what lies before the first match belongs to the first unit."""
        if at == 0 and self.raw:
            yield 0
        for m in self.unit.finditer(self.raw, at):
            if m.start() > 0 and m.end() > m.start():
                yield m.start()

    def cut(self, k: int) -> tuple[int, int]:
        """(byte offset, code points) of the place after ``k`` units."""
        if k >= self.n_units:
            return len(self.raw), self.n_points
        b, units, points, step = 0, 0, 0, self.top
        while step:
            nxt = b + step
            if nxt < len(self.tree) and units + self.tree[nxt, 0] <= k:
                b, units, points = nxt, units + int(self.tree[nxt, 0]), points + int(self.tree[nxt, 1])
            step >>= 1
        start, left = b * self.block, k - units
        here = self.lead[start:start + self.block]
        if self.unit is None:
            at = start + int(np.flatnonzero(here)[left])
        else:
            at = next(s for j, s in enumerate(self._starts(int(self.first[b]))) if j == left)
        return at, points + int(np.count_nonzero(here[:at - start]))


def recovered(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes | None:
    """The text that an output stands for; None if it does not follow its form."""
    p, s, m = marks
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        return None
    one, found, rest = output[len(first):].partition(second)
    two, found2, middle = rest.partition(m)
    if not (found and found2):
        return None
    return one + middle + two if form == "psm" else two + middle + one


def transformed(raw: bytes, key: str, seed: str, unit, fim_percent: int, spm_percent: int, marks, block: int):
    """(units, form, prefix code points, middle code points, output bytes) of one text."""
    tree = BlockTree(raw, unit, block)
    h1, h2, h3, h4 = draws(seed, key)
    plain = (tree.n_units, "plain", None, None, raw)
    if not raw or any(x in raw for x in marks) or h3 % 100 >= fim_percent:
        return plain
    a, b = sorted((h1 % (tree.n_units + 1), h2 % (tree.n_units + 1)))
    (i, pi), (j, pj) = tree.cut(a), tree.cut(b)
    p, s, m = marks
    form = "spm" if h4 % 100 < spm_percent else "psm"
    pre, mid, suf = raw[:i], raw[i:j], raw[j:]
    out = s + suf + p + pre + m + mid if form == "spm" else p + pre + s + suf + m + mid
    return (tree.n_units, form, pi, pj - pi, out) if recovered(out, form, marks) == raw else plain


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", unit: str | None = None,
                   fim_percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS,
                   block: int = BLOCK) -> DataFrame:
    """One row per document: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``unit`` is a pattern of consecutive units (None: code points).  The cuts are the smaller and the larger of two
    draws from the document's id; a text whose parts could not be told apart again stays plain.  No shuffle."""
    pattern = None if unit is None else re.compile(unit.encode())
    marks = tuple(x.encode() for x in sentinels)
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"),
                      F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"))
    kind = src.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, raws, keys = batch.columns
            start, size, rows = 0, 0, []
            for k in range(len(raws)):
                rows.append(transformed(raws[k].as_py(), keys[k].as_py(), seed, pattern, fim_percent, spm_percent, marks, block))
                size += len(rows[-1][-1])
                if size >= OUT_BYTES or k + 1 == len(raws):
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(start, len(rows)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                         pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
                         pa.array(cols[4], pa.binary()).cast(pa.string())],
                        names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])
                    start, size, rows = k + 1, 0, []

    return src.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text rebuilt from an output and its form (built-in functions only)."""
    parts = F.split(F.col(output), "|".join("\\Q%s\\E" % s for s in sentinels), -1)
    return (F.when(F.col(form) == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2)))
            .when(F.col(form) == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1)))
            .otherwise(F.col(output)))
