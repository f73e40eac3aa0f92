"""Java declaration scanner on our fixture tree, the Java jobs, and the incremental stream."""

import os
import tempfile

from pyspark.sql import functions as F

from legible.operators import extract as E
from legible.plans import jobs as J
from legible.sources.files import scan_files
from legible.streaming import incremental as INC

FIX = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "java")


def test_scan_files_and_quarantine(spark):
    files = scan_files(spark, FIX, [".JAVA"])
    rels = sorted(r.rel_path for r in files.collect())
    assert rels == ["demo/broken/Bad.java", "demo/mix/Ann.java", "demo/mix/Hs.java"]   # no zero-length files
    decls, units, rejects = J.analyze_job(files)
    assert [r.file for r in rejects.collect()] == ["demo/broken/Bad.java"]
    sigs = {r.qualified_signature: r.unit_kind for r in units.collect()}
    assert sigs["demo.mix.Hs.h(String)"] == "method"
    assert sigs["demo.mix.Hs.Hs()"] == "ctor"
    assert sigs["demo.mix.Cache.Cache(Map<K, V>,long)"] == "ctor"
    assert sigs["demo.mix.Hs.In.k()"] == "method"                  # outer kept (Q9)
    assert sigs["demo.mix.Hs.Empty"] == "class"                    # member-less interface is a class-level unit
    assert sigs["demo.mix.Ann.f(java.util.List<String>)"] == "method"   # braces inside annotation / lambda args
    assert "demo.mix.Pt" not in sigs                               # records are documented, not named (Q10)
    kinds = {(r.class_name, r.type_kind, r.has_doc) for r in decls.filter(F.col("unit_kind") == "type").collect()}
    assert ("Hs", "class", True) in kinds and ("Color", "enum", False) in kinds and ("Pt", "record", False) in kinds


def test_strings_and_signals(spark):
    files = scan_files(spark, FIX)
    _, units, _ = J.analyze_job(files)
    q = units.filter(F.col("method_name") == "q").first()
    assert q.strings == ['a{b}\\"c']
    h = units.filter(F.col("method_name") == "h").select(E.behavior_signals(F.col("code"), size="n_statements").alias("s")).first().s
    assert h.loops == 1 and h.size >= 3


def test_annotate_skips_documented_and_keeps_code(spark):
    files = scan_files(spark, FIX).filter(F.col("rel_path") == "demo/mix/Hs.java")
    decls, _, _ = J.analyze_job(files)
    out = J.annotate_job(files, decls).first()
    assert out.new_text.count("/** Existing doc. */") == 1
    import re

    def code_only(t):
        return re.sub(r"\s+", " ", re.sub(r"/\*\*.*?\*/", " ", t, flags=re.S)).strip()
    assert code_only(out.new_text) == code_only(out.text)           # only doc blocks were added
    assert "Computes and returns a hash/checksum." not in out.new_text   # h(String) has no hash keyword
    assert out.n_docs > 5


def test_incremental_rerun_adds_nothing(spark):
    src = tempfile.mkdtemp(prefix="legible-inc-src-")
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(1, "a b"), (2, "b c")], schema).coalesce(1).write.mode("append").parquet(src)
    mapping = spark.createDataFrame([("b", "beta")], "old_key string, new_name string")
    sink, ckpt = INC.run_dirs(spark, "test")
    stream = INC.stream_parquet(spark, src, spark.read.parquet(src).schema)
    INC.incremental_rewrite(stream, mapping, sink, ckpt, key="doc_id")
    first = sorted((r.doc_id, r.new_text) for r in spark.read.parquet(sink).collect())
    assert first == [(1, "a beta"), (2, "beta c")]
    INC.incremental_rewrite(INC.stream_parquet(spark, src, spark.read.parquet(src).schema), mapping, sink, ckpt, "doc_id")
    assert spark.read.parquet(sink).count() == 2                     # rerun: nothing new
    spark.createDataFrame([(3, "b b")], schema).coalesce(1).write.mode("append").parquet(src)
    INC.incremental_rewrite(INC.stream_parquet(spark, src, spark.read.parquet(src).schema), mapping, sink, ckpt, "doc_id")
    got = sorted((r.doc_id, r.new_text) for r in spark.read.parquet(sink).collect())
    assert got == [(1, "a beta"), (2, "beta c"), (3, "beta beta")]


def test_incremental_query_reads_a_table_of_part_files(spark):
    """``documents.parquet`` may be a folder of part files or one file: both are read whole."""
    from legible.plans.catalog import queries
    src = tempfile.mkdtemp(prefix="legible-inc-table-")
    rows = [(i, "de la de %d" % i if i else None) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.repartition(3).write.parquet(src + "/parts/documents.parquet")
    docs.coalesce(1).write.parquet(src + "/one")
    part, = [f for f in os.listdir(src + "/one") if f.startswith("part-")]
    os.makedirs(src + "/file")
    os.rename(src + "/one/" + part, src + "/file/documents.parquet")
    want = sorted((i, t and "value tmp value %d" % i, 0 if t is None else 3) for i, t in rows)
    for kind in ("parts", "file"):
        got = queries()["incremental_rewrite"](spark, src + "/" + kind)
        assert sorted((r.doc_id, r.new_text, r.n_replacements) for r in got.collect()) == want


def test_incremental_over_source_tree(spark):
    root = tempfile.mkdtemp(prefix="legible-inc-tree-")
    os.makedirs(os.path.join(root, "p"))
    with open(os.path.join(root, "p", "A.java"), "w") as f:
        f.write("class A { int a = b; }\n")
    mapping = spark.createDataFrame([("b", "beta")], "old_key string, new_name string")
    sink, ckpt = INC.run_dirs(spark, "tree")
    INC.incremental_rewrite(INC.stream_source_files(spark, root), mapping, sink, ckpt, key="path")
    with open(os.path.join(root, "p", "B.java"), "w") as f:
        f.write("class B { b(); }\n")
    INC.incremental_rewrite(INC.stream_source_files(spark, root), mapping, sink, ckpt, key="path")
    got = sorted((os.path.basename(r.path), r.new_text, r.n_replacements) for r in spark.read.parquet(sink).collect())
    assert got == [("A.java", "class A { int a = beta; }\n", 1), ("B.java", "class B { beta(); }\n", 1)]


def test_sample_shaped_fixture_expectations(spark):
    """Expectations worked out by hand for the sample shapes."""
    from legible.operators import suggest as S
    files = scan_files(spark, os.path.join(os.path.dirname(FIX), "mix"))
    _, units, rejects = J.analyze_job(files)
    assert rejects.count() == 0
    kinds = sorted((r.qualified_signature, r.unit_kind) for r in units.collect())
    assert len(kinds) == 13
    assert sum(1 for _, k in kinds if k == "ctor") == 5 and sum(1 for _, k in kinds if k == "method") == 8
    h = S.heuristic_names(units).collect()
    simple = {r.old_key: r.new_name for r in h if r.kind == "simple"}
    assert simple == {"a": "value", "d": "tmp", "e": "i", "h": "j", "p": "k", "v0": "idx", "w0": "count",
                      "x0": "flag", "y0": "size"}
    assert {r.old_key: r.new_name for r in h if r.kind == "method"} == {"demo.mix.w0.K()": "getw0"}
    parity = {r.old_key for r in S.heuristic_names(units, parity=True).collect() if r.kind == "method"}
    assert parity == {"demo.mix.w0.K()", "demo.mix.a.a()", "demo.mix.w0.w0()", "demo.mix.x0.x0()", "demo.mix.y0.y0()"}
    mapping = J.suggest_job(units)
    keys = [(r.kind, r.old_key) for r in mapping.collect()]
    assert len(keys) == len(set(keys))                              # one rule per (kind, key)


def test_strings_past_the_cut_of_a_long_member(spark):
    body = "".join("        int filler%05d = %d;\n" % (k, k) for k in range(600))
    text = "package p;\nclass Long {\n    void f() {\n        String a = \"first\";\n%s        String z = \"last\";\n    }\n}\n" % body
    _, units, _ = J.analyze_job(spark.createDataFrame([("p/Long.java", text)], "rel_path string, text string"))
    f = units.filter(F.col("method_name") == "f").first()
    assert len(body) > 12000 and len(f.code) > len(body) and "last" in f.code      # only a prompt cuts the code
    from legible.operators.infer import prompt_block
    assert "last" not in prompt_block(units, 10 ** 6, 10 ** 6).filter(F.col("method_name") == "f").first().block.split("```java")[1]
    assert f.strings == ["first", "last"]
