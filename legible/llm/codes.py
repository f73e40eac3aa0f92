"""Vector code compression: product codes with a GNAT over each codebook (op 13).

Vectors become integers, are cut into equal parts, and each part is replaced by its nearest codebook entry.  The
nearest entry is searched in a geometric near-neighbour access tree: a node holds split points, every other entry
below it belongs to its nearest split point's child, and for each (split point, child) the smallest and largest
distance between them.  A query leaves out a child when its own distance to some split point, less the best distance
so far, lies strictly beyond that range.  Roots are rounded outwards, so rounding never hides an entry, and the winner
is decided on exact integer squares, ties to the lower index.

Work on Spark: every round is one pass over the vectors; a task adds up what it assigned per entry, Spark sums those
partial rows, and only the codebooks (``entries`` x dimension integers, a parameter) reach the driver and the tasks.

Edge cases: rows with a null vector or null or non-finite components are dropped, and so are vectors of another length
than the one with the smallest id (they have no parts in common); null ids come first; rows that repeat an id are
each coded, the first 256 taken by (id, vector); null labels are one label; fewer rows than entries give fewer
entries; an empty table gives no row.  Components so large that a squared distance leaves 63 bits raise an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legible.llm.common import stage

EXACT = 1 << 53                 # integers that a double holds exactly


SLACK = 2.0 ** -40              # roots and ranges are widened by this share, far more than any rounding of theirs


def reach(*rows: np.ndarray) -> int:
    """The largest component of either sign, as a Python integer."""
    return max((max(abs(int(x.min())), abs(int(x.max()))) for x in rows if x.size), default=0)


def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices (len(p) x len(q)): whole doubles where they are exact."""
    if not len(q) or not len(p):
        return np.zeros((len(p), len(q)))
    bound = p.shape[1] * (2 * reach(p, q)) ** 2
    if bound < EXACT:
        a, b = p.astype(np.float64), q.astype(np.float64)
        return _expanded(a, b, (a * a).sum(1), (b * b).sum(1))
    if bound >= 1 << 63:
        raise ValueError("vector components too large: a squared distance needs more than 63 bits")
    out = np.empty((len(p), len(q)), np.int64)
    for j in range(len(p)):
        d = q - p[j]
        out[j] = (d * d).sum(1)
    return out


def _expanded(a: np.ndarray, b: np.ndarray, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2
    d += aa[:, None]
    d += bb
    return d


class Gnat:
    """The tree over the rows of ``points``; ``nearest`` answers many queries at once."""

    def __init__(self, points: np.ndarray, arity: int = 16):
        self.points, self.arity = np.ascontiguousarray(points, np.int64), arity
        self.root = self._node(np.arange(len(points))) if len(points) else None
        self.tested = 0                                     # distances computed, for measurements

    def _node(self, ids: np.ndarray, kids: tuple = ()) -> dict:
        if len(ids) > self.arity:
            # split points far apart: each next one is the entry farthest from those chosen
            chosen = [0]
            gap = squares(self.points[ids[:1]], self.points[ids])[0]
            while len(chosen) < self.arity:
                chosen.append(int(gap.argmax()))
                gap = np.minimum(gap, squares(self.points[ids[chosen[-1:]]], self.points[ids])[0])
                gap[chosen] = -1
            chosen = np.sort(np.array(chosen))
            ids, rest = ids[chosen], np.delete(ids, chosen)
            d = squares(self.points[ids], self.points[rest])
            home, root = d.argmin(0), np.sqrt(d.astype(np.float64))
            kids = [(j, self._node(rest[home == j]), root[:, home == j].min(1)[:, None] * (1 - SLACK),
                     root[:, home == j].max(1)[:, None] * (1 + SLACK)) for j in range(len(ids)) if (home == j).any()]
        mine = self.points[ids].astype(np.float64)
        return {"ids": ids, "kids": kids, "points": mine, "norms": (mine * mine).sum(1)}

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest entry."""
        best = np.full(len(q), np.iinfo(np.int64).max)
        index = np.zeros(len(q), np.int64)
        if self.root is not None and len(q):
            whole = q.shape[1] * (2 * reach(q, self.points)) ** 2 < EXACT
            x = q.astype(np.float64) if whole else q
            self._visit(self.root, x, (x * x).sum(1) if whole else None, np.arange(len(q)), best, index)
        return index, best

    def _visit(self, node: dict, q: np.ndarray, norms, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """``norms``: the queries' squared lengths where doubles are exact, else None."""
        if not len(rows):
            return
        if norms is None:
            d = squares(self.points[node["ids"]], q[rows])
        else:
            d = _expanded(node["points"], q[rows], node["norms"], norms[rows])
        self.tested += d.size
        home = d.argmin(0)                                  # ids ascend, so the first minimum is the lowest index
        least, which = d[home, np.arange(len(rows))].astype(np.int64), node["ids"][home]
        old = best[rows]
        wins = (least < old) | ((least == old) & (which < index[rows]))
        best[rows[wins]], index[rows[wins]] = least[wins], which[wins]
        if not node["kids"]:
            return
        for j, kid, _, _ in node["kids"]:                   # the own child first: it gives a tight radius
            self._visit(kid, q, norms, rows[home == j], best, index)
        root = np.sqrt(d.astype(np.float64))
        radius = np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
        inner, outer = root * (1 - SLACK) - radius, root * (1 + SLACK) + radius
        for j, kid, low, high in node["kids"]:
            beyond = (inner > high).any(0) | (outer < low).any(0)
            self._visit(kid, q, norms, rows[(home != j) & ~beyond], best, index)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    scale: int = 1024) -> DataFrame:
    """(_id, _label, q) of the usable rows: components times ``scale``, floors taken downwards."""
    usable = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"),
                         F.col(vector_col).cast("array<double>").alias("_v"))
    return src.filter(F.col("_v").isNotNull() & usable).select(
        "_id", "_label", F.transform("_v", lambda x: F.floor(x * scale).cast("long")).alias("q"))


def _matrix(col: pa.Array, parts: int) -> np.ndarray:
    """Rows x parts x components of a batch's list column."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), parts, -1)


def seed_codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the ``entries`` smallest ids (a top-k, bounded by the parameter): parts x entries x components."""
    first = kept.orderBy("_id", "q").select("q").first()
    size = len(first["q"]) if first else 0
    if size % parts:
        raise ValueError(f"{size} components cannot be cut into {parts} equal parts")
    if not size:
        return np.zeros((parts, 0, 0), np.int64)
    rows = kept.filter(F.size("q") == size).orderBy("_id", "q").limit(entries).select("q").collect()
    return np.array([r["q"] for r in rows], np.int64).reshape(len(rows), parts, -1).swapaxes(0, 1)


def refine(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: assign every part, replace each entry by the floored mean of its parts; unused entries stay."""
    parts, entries, width = books.shape

    def assign(batches):
        trees = [Gnat(b) for b in books]
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            q = _matrix(batch.column(0), parts)
            for p in range(parts):
                at = trees[p].nearest(q[:, p])[0] + p * entries
                np.add.at(total, at, q[:, p])
                count += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                         names=["entry", "n", "s"])

    sums = (kept.filter(F.size("q") == parts * width).select("q").mapInArrow(assign, "entry long, n long, s array<long>")
            .groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)]))
    new = books.reshape(-1, width).copy()
    for r in sums.collect():                                # at most parts x entries rows
        new[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return new.reshape(books.shape)


def train_codebooks(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    books = seed_codebooks(kept, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = refine(kept, books)
    return books


def encode_vectors(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(_id, _label, codes array<int>, error): nearest entries by part, squared distances summed over parts."""
    parts, entries, width = books.shape

    def assign(batches):
        trees = [Gnat(b) for b in books]
        for batch in batches:
            q = _matrix(batch.column(2), parts)
            found = [trees[p].nearest(q[:, p]) for p in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel())),
                 pa.array(sum(f[1] for f in found))], names=["_id", "_label", "codes", "error"])

    kinds = [kept.schema[c].dataType.simpleString() for c in ("_id", "_label")]
    usable = kept.filter(F.size("q") == parts * width if books.size else F.lit(False))
    return usable.mapInArrow(assign, f"_id {kinds[0]}, _label {kinds[1]}, codes array<int>, error long")


def decode_vector(codes: list[int], books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[p, c] for p, c in enumerate(codes)])


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
                     id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks); rows: id, label, codes, code (two hex digits a part), error, label_error.

    Label totals are partial sums first and join back null-safely as an ordinary shuffle join, which the session's
    adaptive execution turns into a broadcast when the totals measure small and splits where one label is hot."""
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits holds 1 to 256 entries")
    kept = integer_vectors(vectors, id_col, vector_col, label_col, scale)
    books = train_codebooks(kept, parts, entries, rounds)
    coded = stage(encode_vectors(kept, books), "vector-codes")
    totals = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = coded.join(totals, coded["_label"].eqNullSafe(totals["_of"])).select(
        F.col("_id").alias(id_col), F.col("_label").alias(label_col), "codes", code.alias("code"), "error", "label_error")
    return rows, books
