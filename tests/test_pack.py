"""Packing: the distributed forms must equal a plain sequential fold (property tests)."""

import random

from pyspark.sql import functions as F

from legible.operators.order import dense_seq, fixed_slices, top_k_per_group
from legible.operators.pack import pack_by_budget


def greedy(tokens, budget, max_items):
    """Reference semantics written directly: (batch_no, pos) per item."""
    out, b, cur, n = [], -1, 0, 0
    for t in tokens:
        t = max(1, t)
        if b < 0 or (n > 0 and (cur + t > budget or n >= max_items)) or cur > budget:
            b, cur, n = b + 1, 0, 0
        out.append((b, n))
        cur += t
        n += 1
    return out


def _check(spark, groups, budget, max_items, small_group_max):
    rows = [(g, i * 3 + 1, t) for g, toks in groups.items() for i, t in enumerate(toks)]
    df = spark.createDataFrame(rows, "g bigint, o bigint, tok bigint")
    got = pack_by_budget(df, ["g"], ["o"], token_col="tok", budget=budget, max_items=max_items,
                         small_group_max=small_group_max).select("g", "o", "batch_no", "pos").collect()
    got = {(r.g, r.o): (r.batch_no, r.pos) for r in got}
    for g, toks in groups.items():
        want = greedy(toks, budget, max_items)
        assert [got[(g, i * 3 + 1)] for i in range(len(toks))] == want, g


def test_pointer_doubling_matches_fold(spark):
    rnd = random.Random(7)
    groups = {g: [rnd.choice([1, 5, 20, 60, 150]) for _ in range(rnd.randint(1, 70))] for g in range(12)}
    groups[99] = [rnd.randint(1, 40) for _ in range(300)]          # one hot group
    _check(spark, groups, budget=100, max_items=4, small_group_max=0)   # force the distributed path


def test_small_group_fold_matches(spark):
    rnd = random.Random(3)
    groups = {g: [rnd.randint(1, 250) for _ in range(rnd.randint(1, 9))] for g in range(20)}
    _check(spark, groups, budget=200, max_items=3, small_group_max=256)


def test_oversize_item_stands_alone(spark):
    _check(spark, {0: [10, 500, 10, 10, 10]}, budget=100, max_items=12, small_group_max=0)


def test_dense_seq_and_slices(spark):
    rows = [(0 if i % 3 else 1, i) for i in range(200)]            # group 0 holds two thirds
    df = spark.createDataFrame(rows, "g int, o int")
    got = dense_seq(df, ["g"], ["o"]).collect()
    for g in (0, 1):
        seqs = sorted((r.o, r.seq) for r in got if r.g == g)
        assert [s for _, s in seqs] == list(range(len(seqs)))
    sl = fixed_slices(df, ["g"], ["o"], 12).filter(F.col("g") == 0).orderBy("o").collect()
    assert [r.slice_no for r in sl[:13]] == [0] * 12 + [1]


def test_top_k_per_group(spark):
    df = spark.createDataFrame([("a", "n%03d" % i) for i in range(100)] + [("b", "z")], "folder string, name string")
    got = top_k_per_group(df, ["folder"], ["name"], 5, salt_buckets=7).collect()
    assert sorted(r.name for r in got if r.folder == "a") == ["n%03d" % i for i in range(5)]
    assert [r.name for r in got if r.folder == "b"] == ["z"]
