"""Faults found in review: numbering with payload and null groups, rule sets of any size, saved retries, tolerant reading."""

import os

from legible.operators import infer as I
from legible.operators import rewrite as R
from legible.operators.folders import move_paths
from legible.operators.order import dense_seq, fixed_slices
from legible.operators.pack import pack_by_budget
from legible.plans.jobs import apply_job
from legible.sources.files import scan_files, scan_rejects
from pyspark.sql import functions as F


def test_dense_seq_carries_payload_over_many_partitions(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g"),
        F.xxhash64("id").alias("o"), F.md5(F.col("id").cast("string")).alias("payload"))
    got = dense_seq(df, ["g"], ["o"], num_partitions=16).groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.min("seq").alias("lo"), F.max("seq").alias("hi"),
        F.countDistinct("payload").alias("p")).collect()
    assert sum(r["n"] for r in got) == n and len(got) == 3
    assert all(r["n"] == r["d"] == r["hi"] + 1 == r["p"] and r["lo"] == 0 for r in got)


def test_null_groups_are_numbered_and_packed(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 1, "c")], "g string, o int, t string")
    assert fixed_slices(df, ["g"], ["o"], 1).count() == 3
    for small in (256, 0):
        rows = pack_by_budget(df, ["g"], ["o"], text_col="t", budget=9, max_items=1, small_group_max=small).collect()
        assert sorted((r["g"] or "", r["o"], r["batch_no"], r["pos"]) for r in rows) == [("", 1, 0, 0), ("", 2, 1, 0), ("x", 1, 0, 0)]


def test_token_rules_mean_the_same_at_every_size(spark):
    files = spark.createDataFrame([(1, "k0 a.b na\u00efve k1 k1x $d")], "doc_id int, text string")
    few = [("k0", "z0", 1), ("k0", "y0", 0), ("a.b", "no", 0), ("na\u00efve", "no", 0), ("$d", "e", 0)]
    for extra in (0, 300):
        rules = spark.createDataFrame(few + [("k%d" % i, "n%d" % i, 0) for i in range(1, extra)] + [("k1", "n1", 0)],
                                      "old_key string, new_name string, prio int")
        r = R.rewrite_tokens(files, rules).first()
        assert (r["new_text"], r["n_replacements"]) == ("y0 a.b na\u00efve n1 k1x e", 3)
        assert {(x["old_key"], x["hits"]) for x in R.count_replacements(files, rules).collect()} == {("k0", 1), ("$d", 1), ("k1", 1)}


def test_many_class_rules_apply(spark):
    n = 150
    mapping = spark.createDataFrame([("class", "p.C%d" % i, "q.New%d" % i, i) for i in range(n)],
                                    "kind string, old_key string, new_name string, prio long")
    files = spark.createDataFrame([("p/A.java", "package p;\nimport p.C7;\n  import p.C149 ;\nimport p.C7x;\nclass A { C7 x; C149 y; }")],
                                  "rel_path string, text string")
    r = apply_job(files, mapping).first()
    assert r["new_text"] == "package p;\nimport q.New7;\nimport q.New149;\nimport p.C7x;\nclass A { New7 x; New149 y; }"


def test_retries_are_saved(spark):
    import uuid
    mark = "/tmp/legible-calls-%s" % uuid.uuid4().hex

    def provider(prompts):
        with open(mark, "a") as f:
            f.write("x" * len(prompts))
        raise TimeoutError("timeout")

    prompts = spark.createDataFrame([(i, "p%d" % i) for i in range(5)], "k int, prompt string")
    once = I.RetryPolicy(tries=1)
    from legible.session import cut_lineage
    first = cut_lineage(I.batch_infer(prompts, provider, ["k"], policy=once))
    out = I.retry_failed(first, prompts, provider, ["k"], rounds=1, policy=once)
    calls = os.path.getsize(mark)
    assert out.count() == 5 and len(out.collect()) == 5
    assert os.path.getsize(mark) == calls


def test_reply_aliases(spark):
    df = spark.createDataFrame([(1, '[{"kind":"var","oldName":"a","newName":"b"}]')], "k int, reply string")
    assert [tuple(r) for r in I.parse_suggestions(df, ["k"]).collect()] == [(1, 0, "var", "a", "b")]


def test_scan_tolerates_bad_bytes_and_roots(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "A.JAVA").write_text("class A {}", encoding="utf-8")
    (tmp_path / "d" / "B.java").write_bytes("class \xe9 {}".encode("latin-1"))
    (tmp_path / "d" / "c.bin").write_bytes(b"\xff" * 10)
    for root in (str(tmp_path), "file://" + str(tmp_path), "file:" + str(tmp_path) + "/"):
        assert [r["rel_path"] for r in scan_files(spark, root).collect()] == ["d/A.JAVA"]
        assert [r["rel_path"] for r in scan_rejects(spark, root).collect()] == ["d/B.java"]


def test_root_folder_keeps_bare_name(spark):
    files = spark.createDataFrame([("", "A.java"), ("x", "B.java")], "folder string, file_name string")
    plan = spark.createDataFrame([("x", "y")], "folder string, new_folder string")
    assert {r["new_path"] for r in move_paths(files, plan).collect()} == {"A.java", "y/B.java"}
