"""Greedy budget packing (W9) without a sequential fold over a whole group.

The reference walks items in order and starts a new batch when the next item would pass the
token budget or the batch already has ``max_items`` items; an item above the budget stands alone.
That fold is exact but sequential.  Here it is computed as a pointer problem:

1. ``next(i)`` — where the next batch starts if a batch starts at item ``i`` — only depends on
   the ``max_items`` items from ``i`` on.  Each item is copied to at most ``max_items`` candidate
   starts and aggregated per start (a unique key: no skew, bounded fan-out).
2. The batch starts are the nodes on the path ``0 -> next(0) -> next(next(0)) -> …``.  Pointer
   doubling (``J_{k+1} = J_k ∘ J_k``) and a doubling frontier give every node on that path and its
   distance from 0 — the batch number — in O(log n) equi-join rounds, for all groups at once.
3. Each start expands to its members with ``sequence(start, next-1)`` (fan-out <= ``max_items``).

No group is ever collected into one task, so a group holding a third of all rows is split over
the whole cluster; lineage is cut with reliable checkpoints in the shared checkpoint folder.
Only when a probe has measured every group at <= SMALL_GROUP_MAX items is the plain fold used
(one stage, one bounded array per group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legible.functions.text import approx_tokens
from legible.operators.order import dense_seq
from legible.operators.util import join_nulls
from legible.session import checkpoint_dir, cut_lineage

# ---- fixed values that must equal the reference's behaviour ---------------------------------
TOKEN_BUDGET = 9000
MAX_ITEMS = 12
# ----------------------------------------------------------------------------------------------



def _next_start(items: DataFrame, keys: list[str], budget: int, max_items: int) -> DataFrame:
    """(keys, seq, nxt): the start of the following batch when a batch starts at ``seq``."""
    cand = items.select(*keys, "seq", "tok",
                        F.explode(F.sequence(F.lit(0).cast("bigint"),
                                               F.least(F.col("seq"), F.lit(max_items - 1).cast("bigint")))).alias("k"))
    cand = cand.select(*keys, (F.col("seq") - F.col("k")).alias("start"), "k", "tok")
    per = cand.groupBy(*keys, "start").agg(F.array_sort(F.collect_list(F.struct("k", "tok"))).alias("w"))
    init = F.struct(F.lit(0).cast("bigint").alias("cum"), F.lit(None).cast("bigint").alias("nxt"))

    def step(acc, it):
        cum, nxt = acc["cum"], acc["nxt"]
        k, t = it["k"].cast("bigint"), it["tok"]
        first = k == 0
        new_nxt = (F.when(nxt.isNotNull(), nxt)
                    .when(first & (t > budget), F.col("start") + 1)
                    .when(~first & (cum + t > budget), F.col("start") + k))
        new_cum = F.when(nxt.isNull() & new_nxt.isNull(), cum + t).otherwise(cum)
        return F.struct(new_cum.alias("cum"), new_nxt.alias("nxt"))

    folded = F.aggregate("w", init, step)
    # no cut inside the window: the batch takes every item we saw (max_items or the group's end)
    nxt = F.coalesce(folded["nxt"], F.col("start") + F.size("w"))
    return per.select(*keys, F.col("start").alias("seq"), nxt.cast("bigint").alias("nxt"))


SMALL_GROUP_MAX = 256   # measured bound under which a group is folded in one task


def _fold_small_groups(items: DataFrame, keys: list[str], budget: int, max_items: int) -> DataFrame:
    """Exact sequential fold per group, used only when the probe proved every group <= SMALL_GROUP_MAX."""
    g = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "tok"))).alias("xs"))
    init = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("cur"),
                    F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"),
                    F.array().cast("array<struct<seq:bigint,batch_no:bigint,pos:bigint>>").alias("out"))

    def step(acc, it):
        t = it["tok"]
        new = (acc["b"] < 0) | (acc["cur"] + t > budget) | (acc["n"] >= max_items)
        b = F.when(new, acc["b"] + 1).otherwise(acc["b"])
        pos = F.when(new, F.lit(0).cast("bigint")).otherwise(acc["pos"] + 1)
        cur = F.when(new, t).otherwise(acc["cur"] + t)
        n = F.when(new, F.lit(1).cast("bigint")).otherwise(acc["n"] + 1)
        rec = F.struct(it["seq"].alias("seq"), b.alias("batch_no"), pos.alias("pos"))
        return F.struct(b.alias("b"), cur.alias("cur"), n.alias("n"), pos.alias("pos"),
                        F.concat(acc["out"], F.array(rec)).alias("out"))

    folded = g.select(*keys, F.explode(F.aggregate("xs", init, step)["out"]).alias("r"))
    return folded.select(*keys, F.col("r.seq").alias("_seq"), F.col("r.batch_no").alias("batch_no"),
                         F.col("r.pos").alias("pos"))


def pack_by_budget(df: DataFrame, group_cols: list[str], order_cols: list, token_col=None,
                   text_col: str | None = None, budget: int = TOKEN_BUDGET, max_items: int = MAX_ITEMS,
                   seq_col: str | None = None, small_group_max: int = SMALL_GROUP_MAX) -> DataFrame:
    """Add ``batch_no`` (0-based inside the group) and ``pos`` (0-based inside the batch).

    Tokens come from ``token_col`` or ``approx_tokens(text_col)``; every item counts at least 1.
    ``seq_col`` may name an existing dense 0-based ordinal; otherwise one is computed skew-safely.
    """
    keys = list(group_cols)
    spark = df.sparkSession
    if token_col is None:
        tok = approx_tokens(text_col, at_least_one=True)
    else:
        tok = F.greatest(F.lit(1).cast("bigint"), F.col(token_col).cast("bigint"))
    base = df.withColumn("_tok", tok)
    # one partially aggregated probe: group sizes, and whether a single integral order column is
    # already a dense 0..n-1 ordinal (then the range-partitioned numbering is skipped)
    probe_col = seq_col or (order_cols[0] if len(order_cols) == 1 and isinstance(order_cols[0], str) else None)
    integral = probe_col is not None and dict(df.dtypes).get(probe_col) in ("int", "bigint", "smallint", "tinyint")
    aggs = [F.count(F.lit(1)).alias("n")]
    if integral:
        aggs += [F.min(probe_col).alias("lo"), F.max(probe_col).alias("hi"),
                 F.countDistinct(probe_col).alias("nd")]
    stats = df.groupBy(*keys).agg(*aggs)
    summary = stats.agg(F.max("n").alias("max_n"),
                        *([F.min(F.when((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("nd") == F.col("n")), 1).otherwise(0))
                           .alias("dense")] if integral else [])).collect()[0]
    max_n = summary["max_n"] or 0
    dense = bool(seq_col) or (integral and summary["dense"] == 1)
    if dense:   # n distinct values from 0 to n-1: already a dense ordinal
        base = base.withColumn("_seq", F.col(probe_col).cast("bigint"))
    else:
        base = dense_seq(base, keys, order_cols, out="_seq")
    items = base.select(*keys, F.col("_seq").alias("seq"), F.col("_tok").alias("tok"))

    if max_n <= small_group_max:
        assigned = _fold_small_groups(items, keys, budget, max_items)
        return (join_nulls(base, assigned, [*keys, "_seq"]).withColumn("tokens", F.col("_tok"))
                    .drop("_seq", "_tok"))

    checkpoint_dir(spark)
    nxt = cut_lineage(_next_start(items, keys, budget, max_items))
    rounds = max(1, int(max_n).bit_length())

    jump = nxt.select(*keys, "seq", F.col("nxt").alias("j"))
    path = items.filter(F.col("seq") == 0).select(*keys, "seq", F.lit(0).cast("bigint").alias("dist"))
    for r in range(rounds):
        step = 1 << r
        moved = (join_nulls(path, jump, [*keys, "seq"])
                     .select(*keys, F.col("j").alias("seq"), (F.col("dist") + step).alias("dist")))
        # distances 0..2^r-1 and 2^r..2^(r+1)-1 are disjoint: a plain union, no dedup shuffle;
        # the terminal node (seq == n) has no jump entry, so nothing moves past a group's end
        path = path.unionByName(moved)
        if r + 1 < rounds:
            j2 = jump.alias("a").join(jump.alias("b"),
                                      [F.col("a." + k).eqNullSafe(F.col("b." + k)) for k in keys] +
                                      [F.col("a.j") == F.col("b.seq")], "left")
            jump = j2.select(*[F.col("a." + k).alias(k) for k in keys], F.col("a.seq").alias("seq"),
                             F.coalesce(F.col("b.j"), F.col("a.j")).alias("j"))
        # the frontier reuses itself every round: cut the lineage so the plan stays linear
        path = cut_lineage(path)
        if r + 1 < rounds:
            jump = cut_lineage(jump)

    starts = join_nulls(path, nxt, [*keys, "seq"])     # drops the terminal node (seq == n)
    members = starts.select(*keys, F.col("dist").alias("batch_no"), F.col("seq").alias("_start"),
                            F.explode(F.sequence(F.col("seq"), F.col("nxt") - 1)).alias("_seq"))
    out = (join_nulls(base, members, [*keys, "_seq"])
               .withColumn("pos", (F.col("_seq") - F.col("_start")).cast("bigint"))
               .withColumn("tokens", F.col("_tok"))
               .drop("_seq", "_start", "_tok"))
    return out
