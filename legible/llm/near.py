"""N-gram Jaccard join by PartEnum signatures.

Two documents link when ``100 * intersection >= percent * union`` of their word-shingle sets.  For sets of
sizes a and b that means a Hamming distance of at most ``(a + b) (100 - percent) / (100 + percent)``.

*Size bands.*  Band i holds sizes l..floor(100 l / percent); linked sets lie in the same or in neighbouring
bands, so a set signs for the instance of its own band and for the next one.

*Signatures.*  For an instance with distance bound k the domain of shingles (their hash range) is cut into
``n1`` partitions, each into ``n2`` pieces, and all subsets of ``n2 - k2`` pieces of a partition are
enumerated; a signature is the hash of the set's shingles in the subset.  With ``n1 > k / (k2 + 1)`` some
partition holds at most k2 differing pieces, so linked sets share a signature.  There are ``slack`` more partitions
than needed.  With whole partitions (k2 = 0) linked sets agree on ``slack + 1`` of them or more, and a set leaves out its
``slack`` smallest projections in an order of their contents: the largest one that linked sets agree on has ``slack`` below it
in both sets, so both sign it.  Projections of one or two shingles, which many unrelated sets have, hardly sign then.  With
pieces a set leaves out its empty projections unless it has more than ``slack`` partitions with such.

*Candidates.*  Signatures held by one set only are dropped.  Sets of a small bucket are paired.  In a crowded
bucket (a large family of near copies) pairing all would be quadratic: its sets are joined further on the
rarest shingles of each set (a linked pair must share one early in rarest-first order).  First every set is compared with the most
central set of its rare-shingle groups, which is linear; then only pairs whose sets are still in different
components are formed.  All candidates are verified on the exact sets, after a bound by short marks; the sets are
written once, bucketed by node, and only those of the hubs of pairs travel again.

Edge cases: null, empty and blank texts have the empty set and link with nothing; fewer words than a shingle
give the whole sequence as one shingle; equal sets are one class (never paired); null ids take part like any
id but a component is named by its smallest non-null id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legible.llm.common import (forgetting, mix, partitions, plain, shingles, stage, stage_by, text_batches, unstage,
                                word_hashes)
from legible.llm.components import components

#: Members up to which a signature's bucket is paired directly.
SMALL = 8
#: Distance bounds up to which subsets of pieces are enumerated (larger bounds use whole partitions).
ENUMERATE = 6
#: Bits of a set's mark.
MARK = 2048
#: Bits of a signature that travel: two sets that agree in these only are one more candidate, never a lost one.
SIGNED = 48
#: Bits of the bitmap of wanted ids (16 MB at every size).
SPARED = 1 << 27


class Bands:
    """Size bands and the partition parameters of their instances, for one threshold."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [0]

    def of(self, size: int) -> int:
        """Band number (1, 2, ...) of a set size."""
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.tops, size))

    def plan(self, band: int) -> tuple[int, int, int, int]:
        """``n1, n2, k2, slack`` of an instance: both sets have at most the band's top size."""
        while len(self.tops) <= band:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        k = 2 * self.tops[band] * (100 - self.percent) // (100 + self.percent)
        if k == 0:
            return 1, 1, 0, 0
        k2 = 1 if k <= ENUMERATE else 0
        slack = 1 if k2 else k // 2
        return -(-(k + 1) // (k2 + 1)) + slack, 3 if k2 else 1, k2, slack


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of a sorted distinct shingle-hash set."""
    own, out = bands.of(len(s)), []
    for band in (own, own + 1):
        n1, n2, k2, slack = bands.plan(band)
        pieces = n1 * n2
        # ascending hashes fall into ascending pieces of the hash range
        piece = ((s >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
        ends = np.searchsorted(piece, np.arange(pieces + 1, dtype=np.uint64))
        salted = mix(s + mix(piece + np.uint64(band << 32)))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted, dtype=np.uint64)])
        sums, count = run[ends[1:]] - run[ends[:-1]], np.diff(ends)
        if k2 == 0:
            sums, full = sums[:, None], np.ones((n1, 1), np.bool_)
            full[np.lexsort((sums[:, 0], count))[:slack]] = False  # stable: equal contents stand in order of place
        else:  # all subsets of n2 - 1 pieces: the partition without one piece
            sums, count = sums.reshape(n1, n2), count.reshape(n1, n2)
            sums, count = sums.sum(1, dtype=np.uint64, keepdims=True) - sums, count.sum(1, keepdims=True) - count
            full = count > 0
            if (~full).any(1).sum() > slack:
                full[:] = True
        which = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape)
        out.append(mix(sums + mix(which + np.uint64(band << 32) + np.uint64(1)))[full])
    return np.concatenate(out)


def _sets(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    h, ends = word_hashes(texts, lower=True)
    for i in range(len(texts)):
        yield shingles(h[ends[i]:ends[i + 1]], n)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))


def _node() -> F.Column:
    """The 16 bytes of a set's digest."""
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("hi", "lo")])).alias("node")


def _mark(s: np.ndarray) -> np.ndarray:
    """``MARK`` bits of a set: those that its shingles' lowest bits name."""
    bits = np.zeros(MARK, np.bool_)
    bits[s & np.uint64(MARK - 1)] = True
    return np.packbits(bits).view(np.int64)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of nodes whose exact sets are similar enough, as a staged table.

    Marks go first, since whole sets are long: every bit that one mark alone has is a shingle that the other set
    lacks, so the common shingles are at most the set's size less those bits.  Pairs that this bound cannot
    exclude meet their exact sets."""
    def enough(both: F.Column, n: F.Column) -> F.Column:
        return 100 * both >= percent * (n - both)

    def alone(x: str, y: str) -> F.Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)

    marks = plain(sets)
    x = marks.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("mark").alias("_p"))
    y = marks.select(F.col("node").alias("b"), F.col("n").alias("_m"), F.col("mark").alias("_q"))
    most = F.least(F.col("_n") - alone("_p", "_q"), F.col("_m") - alone("_q", "_p"))
    able = stage(pairs.join(x, "a").join(y, "b").filter(enough(most, F.col("_n") + F.col("_m"))).select("a", "b"), "near-able")
    led = _led(able)
    hubs = stage(sets.join(led.select(F.col("hub").alias("node")).distinct(), "node", "left_semi").select("node", "shingles"), "near-hubs")
    x = led.join(sets.select(F.col("node").alias("end"), F.col("shingles").alias("_x")), "end")
    y = hubs.select(F.col("node").alias("hub"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    links = stage(x.join(y, "hub").filter(enough(both, F.size("_x") + F.size("_y")))
                  .select(F.col("end").alias("a"), F.col("hub").alias("b")), "near-links")
    unstage(able, led, hubs)
    return links


def _led(pairs: DataFrame) -> DataFrame:
    """The pairs as ``end, hub``: the hub is the node with more pairs (ties: the larger node).

    An end of d pairs has only hubs of d pairs or more, so of m pairs no end has over sqrt(2 m): ends are never
    hot keys, and the whole sets that go to their hubs are few."""
    many = stage(pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d")), "near-degrees")
    at = (pairs.join(many.select(F.col("v").alias("a"), F.col("d").alias("_d")), "a")
          .join(many.select(F.col("v").alias("b"), F.col("d").alias("_e")), "b"))
    p, q = F.struct(F.col("_d").alias("d"), F.col("a").alias("v")), F.struct(F.col("_e").alias("d"), F.col("b").alias("v"))
    led = stage(at.select(F.least(p, q)["v"].alias("end"), F.greatest(p, q)["v"].alias("hub")), "near-led")
    unstage(many)
    return led


def _perhaps(ids: DataFrame, col: str) -> Callable[[F.Column], F.Column]:
    """A test of an id that is false only for ids outside ``ids[col]``: one bit of a bitmap of constant size for each
    hash.  It spares most unwanted texts the shuffle of the exact join that follows; the fuller the bitmap, the fewer."""
    def place(c: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(c), F.lit(SPARED)) + 1

    per = 32768  # bits of one of Spark's bitmaps
    found = (ids.select(place(F.col(col)).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("k"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m")).collect())
    bits = np.zeros((SPARED // per, per // 8), np.uint8)
    for r in found:
        bits[r["k"] - 1] = np.frombuffer(bytes(r["m"]), np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bits.tobytes())

    @F.pandas_udf("boolean")
    def held(v: pd.Series) -> pd.Series:
        at = v.to_numpy() - 1
        return pd.Series((np.frombuffer(shared.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda c: held(place(c))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4,
                 percent: int = 85) -> DataFrame:
    """Per input row: ``<id_col>, n_shingles, class_id, component_id``.

    ``class_id`` is the smallest id with the same shingle set, ``component_id`` the smallest id reachable by
    links (both the row's own id where the set is empty)."""
    src = _source(docs, id_col, text_col)
    kind = src.schema["_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(s), *_digest(s)) for s in _sets(b.column(1).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))],
                                             ["_id", "n", "hi", "lo"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for b in batches:
            seen, sigs, his = set(), [], []
            for s in _sets(b.column(0).to_pylist(), n):
                if len(s) and (d := _digest(s)) not in seen:
                    seen.add(d)
                    g = signatures(s, bands)
                    sigs.append(g >> np.uint64(64 - SIGNED))
                    his.append(np.full(len(g), d[0], np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(his))], ["sig", "hi"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, want = [], zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            for s, w in zip(_sets(b.column(0).to_pylist(), n), want):
                if _digest(s) == w:
                    found.append((*w, len(s), _mark(s), s.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([f[k] for f in found], pa.int64()) for k in range(3)),
                 *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (3, 4))], ["hi", "lo", "n", "mark", "shingles"])

    rows = stage(src.mapInArrow(forgetting(describe), f"_id {kind}, n bigint, hi bigint, lo bigint"), "near-rows")
    classes = rows.filter("n > 0").groupBy("hi", "lo").agg(F.min("_id").alias("rep"), F.min("n").alias("n"))

    # signatures that two different sets hold
    own = Window.partitionBy("sig")
    shared = stage(
        src.select("_text").mapInArrow(forgetting(sign), "sig bigint, hi bigint")
        .repartition(partitions(docs.sparkSession), "sig")
        .withColumn("_min", F.min("hi").over(own)).withColumn("_max", F.max("hi").over(own))
        .filter("_min < _max").select("sig", "hi").distinct(), "near-shared")
    held = shared.select("hi").distinct()
    wanted = stage(classes.join(held, "hi"), "near-wanted")
    perhaps = _perhaps(wanted, "rep")
    sets = stage_by(src.filter(perhaps(F.col("_id"))).join(wanted, src["_id"].eqNullSafe(wanted["rep"])).select("_text", "hi", "lo")
                 .mapInArrow(forgetting(collect), "hi bigint, lo bigint, n bigint, mark array<bigint>, shingles array<bigint>")
                    .select(_node(), "n", "mark", "shingles").repartition(partitions(docs.sparkSession), "node").dropDuplicates(["node"]),
                    "node", "near-sets")

    pairs, crowd, buckets = _first_pairs(shared, wanted.select("hi", _node(), "n"), sets, percent)
    links = verified(pairs, sets, percent)
    unstage(shared, buckets)
    if crowd is not None:
        links = links.union(verified(_late_pairs(crowd, components(links), percent), sets, percent))
        unstage(crowd)
    unstage(sets)
    label = components(links)
    named = wanted.select(_node(), "rep").join(label, "node")
    names = named.join(named.groupBy("label").agg(F.min("rep").alias("component")), "label").select("node", "component")
    of = classes.select("hi", "lo", "rep", _node()).join(names, "node", "left")
    of = of.select("hi", "lo", "rep", F.coalesce("component", "rep").alias("component"))
    return (rows.join(of, ["hi", "lo"], "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "_id").alias("class_id"),
        F.coalesce("component", "_id").alias("component_id")))


def _first_pairs(shared: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Pairs of small buckets and, for sets of crowded buckets, pairs with the centres of their rare-shingle groups;
    the rare-shingle rows (None without crowded buckets) and the sized buckets too."""
    sized = stage(shared.join(sizes, "hi").select("sig", "node", "n").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("sig"))),
                  "near-buckets")
    # at most SMALL nodes a list; equal lists (one family shares many signatures) count once
    lists = (sized.filter(F.col("m") <= SMALL).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("n", "node"))).alias("l"))
             .select("l").distinct())
    pairs = lists.select(F.explode(F.flatten(F.transform("l", lambda x, i: F.transform(F.filter(
        F.slice("l", i + 2, SMALL), lambda y: 100 * x["n"] >= percent * y["n"]),
        lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))))).alias("p")).select("p.a", "p.b")
    crowded = sized.filter(F.col("m") > SMALL).select("node").distinct()
    if crowded.limit(1).count() == 0:
        return pairs.distinct(), None, sized

    tokens = sets.join(crowded, "node", "left_semi").select("node", "n", F.explode("shingles").alias("t"))
    # a shingle of one set only links nothing: such come first in a set's order, so their number is all that is needed
    often = stage(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-often")
    per = Window.partitionBy("node")
    ranked = tokens.join(often, "t").withColumn("alone", F.col("n") - F.count(F.lit(1)).over(per))
    ranked = ranked.select("node", "n", "t", ((F.sum("df").over(per) + F.col("alone")) / F.col("n")).alias("central"),
                           (F.col("alone") + F.row_number().over(per.orderBy("df", "t")) - 1).alias("pos"))
    # a set and any linked one share a shingle among the first n - need + 1
    crowd = stage(ranked.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100.0)), "near-crowd")
    unstage(often)
    centre = (crowd.groupBy("t").agg(F.max(F.struct("central", "node", "n")).alias("c"))
              .select("t", F.col("c.node").alias("c"), F.col("c.n").alias("m")))
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    star = crowd.join(centre, "t").filter((F.col("node") != F.col("c")) & fits).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
    return pairs.union(star).distinct(), crowd, sized


def _late_pairs(crowd: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs on a rare shingle whose sets are in different components so far and whose sizes and positions allow a link."""
    at = crowd.join(label, "node", "left").select("t", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
    x = at.select("t", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "pos", "label")])
    y = at.select("t", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "pos", "label")])
    need = F.ceil((F.col("n_x") + F.col("n_y")) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9)
    return (x.join(y, (x["t"] == y["t"]) & (F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y"))
                   & (F.col("n_x") - F.col("pos_x") >= need) & (F.col("n_y") - F.col("pos_y") >= need)
                   & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")))
            .select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct())
