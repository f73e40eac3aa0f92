"""Offsets and splicing inside a row: plain versions, long rows, plans without a window and without text in a shuffle."""

import random
import re

from legible.operators import rewrite as R
from pyspark.sql import functions as F


def test_starts_of_many_pieces(spark):
    rng = random.Random(1)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 128, 1000, 20_000)] + [None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<int>").select("i", R.starts_of(F.col("a")).alias("s")).collect()
    for r in got:
        want = None if rows[r["i"]] is None else [sum(rows[r["i"]][:0])]
        if want is not None:
            want, at = [], 0
            for x in rows[r["i"]]:
                want.append(at)
                at += x
        assert r["s"] == want


def test_splice_equals_python(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = "".join(rng.choices("ab\n日𝄞é ", k=rng.choice([0, 5, 1023, 1024, 1025, 5000])))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 8)) // 2 * 2))
        rows.append((i, text, [(a, b, "<%d>" % a) for a, b in zip(cuts[::2], cuts[1::2])]))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:int,end:int,new:string>>")
    got = {r["i"]: r["x"] for r in df.select("i", R.splice("t", "s").alias("x")).collect()}
    for i, text, spans in rows:
        out, at = "", 0
        for a, b, new in spans:
            out, at = out + text[at:a] + new, b
        assert got[i] == out + text[at:]


def test_a_long_text_with_many_spans_is_quick(spark):
    text = "a1 xyz " * 60_000
    files = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    mapping = spark.createDataFrame([("simple", "a1", "beta"), ("class", "xyz", "no")], "kind string, old_key string, new_name string")
    got = {r["doc_id"]: (r["new_text"], r["n_replacements"]) for r in R.rewrite_token_spans(files, "[a-z][0-9]", mapping).collect()}
    assert got == {1: (text.replace("a1", "beta"), 60_000), 2: (None, 0), 3: ("", 0)}


def test_occurrences_equal_a_regex_and_rewriting_agrees_with_the_table_form(spark):
    texts = ["ab cd ab", "x1.y2(x1)", "", "日ab ab𝄞ab", "$ab ab$ ab"]
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    occ = R.token_occurrences(files, "[a-z]{2}|[a-z][0-9]", "simple")
    got = sorted((r["doc_id"], r["start"], r["end"], r["old_key"]) for r in occ.collect())
    rx = re.compile(r"(?<![A-Za-z0-9_$])(?:[a-z]{2}|[a-z][0-9])(?![A-Za-z0-9_$])")
    assert got == sorted((i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in rx.finditer(t))
    mapping = spark.createDataFrame([("simple", "ab", "Q"), ("simple", "x1", "ab")], "kind string, old_key string, new_name string")
    a = {r["doc_id"]: (r["new_text"], r["n_replacements"]) for r in R.rewrite_occurrences(files, occ, mapping).collect()}
    b = {r["doc_id"]: (r["new_text"], r["n_replacements"]) for r in R.rewrite_token_spans(files, "[a-z]{2}|[a-z][0-9]", mapping).collect()}
    assert a == b


def test_plans(spark, tmp_path):
    spark.createDataFrame([(1, "ab cd")], "doc_id int, text string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    mapping = spark.createDataFrame([("simple", "ab", "Q")], "kind string, old_key string, new_name string")
    items = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("/** d */").alias("block")))
    for df in (R.token_occurrences(files, "[a-z]{2}", "simple"), R.rewrite_token_spans(files, "[a-z]{2}", mapping), R.attach_docs_in_row(files, items)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan
    assert R.attach_docs_in_row(files, items).first()["new_text"] == "/** d */\nab cd"
