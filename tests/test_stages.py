"""Stage files, the stage ledger, providers across runs, and files named after their types."""

import os
import uuid

import pytest
from legible.operators import extract as E
from legible.operators import infer as I
from legible.operators import rewrite as R
from legible.plans import jobs as J
from legible.plans import pipeline as P
from legible.plans.catalog_providers import Naming, SayingDocs
from legible.sources import files as SF
from pyspark.sql import functions as F

QUICK = I.RetryPolicy(tries=1)


def Counted(inner, path):
    """A provider that adds a byte to a file for each call (made inside a function, so that workers need no test module)."""
    def call(prompts):
        with open(path, "a") as f:
            f.write("x")
        return inner(prompts)
    return call


def _files(spark, n=12):
    rows = [("q/k%d/P%d.java" % (i, i), "package q.k%d;\npublic class P%d {\n  int get%d(int a) { return a; }\n}\n" % (i, i, i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "rel_path string, text string")


def test_a_stage_that_is_cut_off_resumes_without_repeated_calls(spark, tmp_path, monkeypatch):
    calls, docs = str(tmp_path / "names"), str(tmp_path / "docs")
    opts = J.Options(provider=Counted(Naming(), calls), doc_provider=Counted(SayingDocs(), docs), policy=QUICK, max_items=3, retries=0,
                     refactor_packages=True)
    root = str(tmp_path / "run")
    with monkeypatch.context() as m:
        def cut(*a, **k):
            raise RuntimeError("the cluster is gone")
        m.setattr(J, "apply_job", cut)
        with pytest.raises(RuntimeError, match="gone"):
            P.pipeline_job(_files(spark), root, opts)
    asked = os.path.getsize(calls)
    assert asked > 0 and not os.path.exists(docs)
    out = P.pipeline_job(_files(spark), root, opts)
    assert os.path.getsize(calls) == asked
    told = os.path.getsize(docs)
    first = {(r["stage"], r["n_rows"]): r["elapsed_s"] for r in out["state"].collect()}
    assert {s for s, _ in first} == {"declarations", "units", "mapping", "applied", "packages", "new_declarations", "documented"}
    assert all(t > 0 for t in first.values())
    texts = {r["rel_path"]: r["new_text"] for r in out["documented"].collect()}
    assert "int m_get0(int value)" in next(t for p, t in texts.items() if p.endswith("/P0.java"))
    # finished: nothing is computed or asked again, and no state row is added
    again = P.pipeline_job(_files(spark), root, opts)
    assert (os.path.getsize(calls), os.path.getsize(docs)) == (asked, told)
    assert again["state"].count() == len(first) and {r["rel_path"]: r["new_text"] for r in again["documented"].collect()} == texts
    # other input is another version
    other = P.pipeline_job(_files(spark, 5), root, opts)
    assert other["applied"].count() == 5 and os.path.getsize(calls) >= asked


def test_an_empty_stage_stops_the_pipeline(spark, tmp_path):
    with pytest.raises(RuntimeError, match="no rows"):
        P.pipeline_job(spark.createDataFrame([("a.java", "// nothing")], "rel_path string, text string"), str(tmp_path / "r"))


def test_snippets_between_analyze_and_suggest(spark, tmp_path):
    _, units, _ = J.analyze_job(_files(spark))
    want = sorted(map(tuple, J.suggest_job(units).select("kind", "old_key", "new_name").collect()))
    for fmt in ("json", "parquet"):
        SF.write_snippets(units, str(tmp_path / fmt), fmt)
    back = SF.read_snippets(spark, str(tmp_path / "json"))
    assert sorted(map(tuple, J.suggest_job(back).select("kind", "old_key", "new_name").collect())) == want
    (tmp_path / "a.json").write_text('[{"file":"A.java","pkg":"p","classFqn":"p.A","className":"A","methodName":"f","paramTypes":["int"],'
                                     '"qualifiedSignature":"p.A.f(int)","decl":"int f(int)","code":"{}","strings":["s"]},\n'
                                     '{"file":"A.java","pkg":"p","classFqn":"p.B","className":"B","methodName":"","qualifiedSignature":"p.B"},'
                                     '{"file":"A.java","className":"B","methodName":"B"}]')
    kinds = [(r["class_name"], r["unit_kind"], r["method_name"]) for r in SF.read_snippets(spark, str(tmp_path / "a.json"), True).orderBy("unit_order").collect()]
    assert kinds == [("A", "method", "f"), ("B", "class", ""), ("B", "ctor", "B")]
    SF.write_snippets(units, str(tmp_path / "cut"), cap=5)
    assert SF.read_snippets(spark, str(tmp_path / "cut")).agg(F.max(F.length("code"))).first()[0] == 5


def test_a_million_rules_round_trip(spark, tmp_path):
    n = 1_000_000
    m = spark.range(0, n, 1, 8).selectExpr("array('class','method','field','simple')[id % 4] AS kind", "concat('k', id) AS old_key",
                                           "concat('n', id) AS new_name", "id AS prio")
    SF.write_mapping_table(m, str(tmp_path / "m"))
    back = SF.read_mapping_table(spark, str(tmp_path / "m"))
    assert back.exceptAll(m).count() == 0 and back.count() == n
    assert "Exchange SinglePartition" not in back._jdf.queryExecution().executedPlan().toString()
    assert len([f for k in os.listdir(tmp_path / "m") if k.startswith("kind=") for f in os.listdir(tmp_path / "m" / k)]) >= 4
    with pytest.raises(ValueError, match="bound"):
        SF.write_mapping(m, str(tmp_path / "x"))


def test_top_types_and_clashes(spark):
    files = spark.createDataFrame([
        ("p/a.java", "package p; class x {} public class a {}"), ("p/b.java", "package p; class b {}"), ("p/c.java", "package p; class c {} class d {}"),
        ("p/e.java", "package p; public enum e { A }"), ("p/Same2.java", "package p; interface Same2 {}"), ("p/f.java", "package p; public class f {}"),
        ("g.java", "class g {}"), ("p/g.java", "class g {}")], "rel_path string, text string")
    rules = [("class", "p." + c, "p.Same", i) for i, c in enumerate("abcdexf")] + [("class", "g", "Gee", 9)]
    out = R.rename_files_for_types(files, E.java_declarations(files), spark.createDataFrame(rules, "kind string, old_key string, new_name string, prio long"))
    assert {r["rel_path"]: r["new_path"] for r in out.collect()} == {
        "p/a.java": "p/Same.java", "p/b.java": "p/Same3.java", "p/c.java": "p/c.java", "p/e.java": "p/e.java", "p/Same2.java": "p/Same2.java",
        "p/f.java": "p/Same4.java", "g.java": "Gee.java", "p/g.java": "p/Gee.java"}


def test_replies_are_kept_across_runs_and_null_keys_are_keys(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "replies")

    class Some:
        def __init__(self, ok):
            self.ok = ok

        def __call__(self, prompts):
            with open(log, "a") as f:
                f.write("x")
            if prompts[0] not in self.ok:
                raise RuntimeError("503" if prompts[0] == "b" else "bad request")
            return ["re " + prompts[0]]
    prompts = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c"), (3, "a")], "k int, prompt string")
    one = I.saved_infer(prompts, Some({"a"}), ["k"], policy=QUICK, rounds=1, path=path)
    assert {(r["k"], r["reply"], r["error"]) for r in one.collect()} == {(None, "re a", None), (3, "re a", None), (1, None, "503"), (2, None, "bad request")}
    assert os.path.getsize(log) == 4                       # a once, c once, b twice
    two = I.saved_infer(prompts, Some({"a", "b", "c"}), ["k"], policy=QUICK, rounds=1, path=path)
    assert {(r["k"], r["reply"]) for r in two.collect()} == {(None, "re a"), (3, "re a"), (1, "re b"), (2, "re c")}
    assert os.path.getsize(log) == 6
    failed = spark.createDataFrame([(None, None, "timeout", 1), (1, "ok", None, 1)], "k int, reply string, error string, attempts int")
    got = I.retry_failed(failed, prompts.filter("k is null or k = 1"), Some({"a"}), ["k"], policy=QUICK)
    assert {(r["k"], r["reply"]) for r in got.collect()} == {(None, "re a"), (1, "ok")}


def test_a_call_that_hangs_times_out(spark):
    def hang(prompts):
        import time
        time.sleep(5)
        return prompts
    import time
    began = time.time()
    reply, error, attempts = I._call_with_retry(hang, "p", I.RetryPolicy(tries=2, initial_ms=1, jitter_ms=0, timeout_s=0.2))
    assert reply is None and "timeout" in error and attempts == 2 and time.time() - began < 4


def test_doc_sources_item_by_item(spark):
    rows = [("F%d.java" % i, "class F%d { void m%s() { } }" % (i, "x" * (i % 4))) for i in range(10)]
    decls = E.java_declarations(spark.createDataFrame(rows, "rel_path string, text string"))
    for size in (1, 3, 100):
        items = J.doc_items(decls, J.Options(doc_provider=SayingDocs(), doc_batch=size, policy=QUICK)).collect()
        assert len(items) == 20 and {r["source"] for r in items} <= {"model", "heuristic"}
        assert all((r["source"] == "model") == r["doc"].startswith("Says ") and r["doc"] for r in items)


def test_globs_reach_the_jobs(spark):
    _, units, _ = J.analyze_job(_files(spark), J.Options(exclude_globs=["q/k1*/**"]))
    assert {r["file"] for r in units.collect()} == {"q/k%d/P%d.java" % (i, i) for i in (0, 2, 3, 4, 5, 6, 7, 8, 9)}
