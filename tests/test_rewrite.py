"""Rewriting properties and span splicing."""

from pyspark.sql import functions as F

from legible.operators import rewrite as R


def _files(spark):
    return spark.createDataFrame([(1, "int a = b + a1; a.b(); $a = a"), (2, "no hits here"), (3, None)],
                                 "doc_id int, text string")


def test_empty_map_is_identity(spark):
    rules = spark.createDataFrame([], "old_key string, new_name string")
    out = R.rewrite_tokens(_files(spark), rules).collect()
    assert all((r.new_text == r.text) and r.n_replacements == 0 for r in out if r.text is not None)


def test_bijection_then_inverse_restores(spark):
    fwd = spark.createDataFrame([("a", "alpha"), ("b", "beta")], "old_key string, new_name string")
    inv = fwd.select(F.col("new_name").alias("old_key"), F.col("old_key").alias("new_name"))
    once = R.rewrite_tokens(_files(spark), fwd).select("doc_id", F.col("new_text").alias("text"))
    back = R.rewrite_tokens(once, inv).collect()
    orig = {r.doc_id: r.text for r in _files(spark).collect()}
    assert {r.doc_id: r.new_text for r in back} == orig


def test_small_and_join_forms_agree(spark):
    rules = spark.createDataFrame([("a", "x"), ("b", "y"), ("a1", "z")], "old_key string, new_name string")
    small = {r.doc_id: (r.new_text, r.n_replacements) for r in R.rewrite_tokens(_files(spark), rules).collect()}
    big = {r.doc_id: (r.new_text, r.n_replacements) for r in R.rewrite_tokens_lookup(_files(spark), rules).collect()}
    assert small == big
    assert small[1] == ("int x = y + z; x.y(); $a = x", 6)   # "$a" is one identifier token


def test_cascade_vs_simultaneous(spark):
    df = spark.createDataFrame([(1, "s i")], "doc_id int, text string")
    rules = [{"kind": "simple", "old": "s", "new": "i", "prio": 0}, {"kind": "simple", "old": "i", "new": "tmp", "prio": 1}]
    assert df.select(R.rewrite_cascade("text", rules)).first()[0] == "tmp tmp"
    m = spark.createDataFrame([("s", "i"), ("i", "tmp")], "old_key string, new_name string")
    assert R.rewrite_tokens(df, m).first().new_text == "i tmp"


def test_import_and_owner_rules(spark):
    df = spark.createDataFrame([("com/x/A.java", "import com.x.B;\nclass A { B b; void f() { f(); } }\n")],
                               "rel_path string, text string")
    rules = [{"kind": "import", "old": "com.x.B", "new": "com.x.Bee"}, {"kind": "class", "old": "B", "new": "Bee"}]
    out = df.select(R.rewrite_cascade("text", rules)).first()[0]
    assert out == "import com.x.Bee;\nclass A { Bee b; void f() { f(); } }\n"
    mapping = spark.createDataFrame([("method", "com.x.A.f()", "run", 0), ("method", "com.x.Other#f(..)", "no", 1)],
                                    "kind string, old_key string, new_name string, prio bigint")
    owned = R.rewrite_owned(df, mapping).first().new_text
    assert owned == "import com.x.B;\nclass A { B b; void run() { run(); } }\n"


def test_splice_occurrences_and_docs(spark):
    files = spark.createDataFrame([(1, "ab cd ab")], "doc_id int, text string")
    occ = R.token_occurrences(files, "ab", "simple")
    assert sorted((r.start, r.end) for r in occ.collect()) == [(0, 2), (6, 8)]
    mapping = spark.createDataFrame([("simple", "ab", "XY")], "kind string, old_key string, new_name string")
    assert R.rewrite_occurrences(files, occ, mapping).first().new_text == "XY cd XY"
    items = spark.createDataFrame([(1, 3, 3, "/** d */")], "doc_id int, start int, end int, block string")
    assert R.attach_docs(files, items).first().new_text == "ab /** d */\ncd ab"


def test_import_prefix_and_package_line(spark):
    files = spark.createDataFrame([(1, "package a.b;\nimport a.b.C;\nimport a.bc.D;\nimport static a.b.E.f;\n")],
                                  "k int, text string")
    pm = spark.createDataFrame([("a.b", "a.util", "1")], "old_pkg string, new_pkg string, prio string")
    out = R.rewrite_import_prefix(files, pm, "k").first()
    assert out.new_text == "package a.b;\nimport a.util.C;\nimport a.bc.D;\nimport static a.util.E.f;\n"
    assert out.n_import_changes == 2
    assert files.select(R.rewrite_package_line("text", F.lit("x.y"))).first()[0].startswith("package x.y;\n")


def test_large_mapping_paths_agree(spark, monkeypatch):
    files = _files(spark)
    rules = spark.createDataFrame([("a", "x"), ("b", "y"), ("a1", "z")], "old_key string, new_name string")
    small_counts = sorted(map(tuple, R.count_replacements(files, rules).collect()))
    small_text = {r.doc_id: r.new_text for r in R.rewrite_tokens(files, rules).collect()}
    monkeypatch.setattr(R, "MAP_LITERAL_MAX", 1)          # force the join forms
    big_counts = sorted(map(tuple, R.count_replacements(files, rules).collect()))
    big_text = {r.doc_id: r.new_text for r in R.rewrite_tokens(files, rules).collect()}
    assert small_counts == big_counts and small_text == big_text
    assert (1, "a", 3) in small_counts
