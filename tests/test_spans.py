"""One-pass rewriting: chains, swaps, line ends and counts, the same by every plan; a model in plain Python."""

import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from legible.operators import lookup
from legible.operators import rewrite as R
from legible.operators.spans import apply_spans
from legible.plans.jobs import apply_job

SCHEMA = "kind string, old_key string, new_name string, prio long"
FILES = "rel_path string, text string"


@pytest.fixture(params=["constant", "used only", "join"])
def size(request, monkeypatch):
    """The three ways a row learns its rules."""
    if request.param == "join":
        monkeypatch.setattr(lookup, "LOOKUP_MAX_ROWS", 0)
    if request.param == "used only":
        real, calls = lookup.measured_lookup, []

        def once_too_large(rules, key="old_key", value="new_name"):
            calls.append(1)
            return None if len(calls) % 2 else real(rules, key, value)
        monkeypatch.setattr(lookup, "measured_lookup", once_too_large)
    return request.param


def test_rules_never_feed_each_other(spark, size):
    mapping = spark.createDataFrame([("class", "p.C1", "p.C2", 0), ("class", "p.C2", "p.C3", 1), ("method", "p.A.get()", "set", 2),
                                     ("method", "p.A#set(..)", "put", 3), ("field", "p.A#f", "g", 4), ("field", "p.A#g", "f", 5),
                                     ("simple", "x", "y", 6), ("simple", "y", "x", 7), ("simple", "f", "lost", 8)], SCHEMA)
    files = spark.createDataFrame([
        ("p/A.java", "import p.C1;\r\nimport q.C1;\r\nclass A { C1 x; C2 y; int f, g; int get () { return set(f, g); } }"),
        ("p/B.java", "import p.C1; // kept\n import\tp.C2 ;\nclass B { int get() { return f; } C3 C1x; }"),
        ("p/N.java", None), ("p/E.java", ""), (None, "x y"), (None, "x y")], FILES)
    got = [(r["rel_path"], r["new_text"], r["n_replacements"], tuple(r["hits"])) for r in apply_job(files, mapping).collect()]
    assert sorted(got, key=repr) == sorted([
        ("p/A.java", "import p.C2;\r\nimport q.C2;\r\nclass A { C2 y; C3 x; int g, f; int set() { return put(g, f); } }", 12, (1, 3, 2, 4, 2)),
        ("p/B.java", "import p.C2; // kept\nimport p.C3;\nclass B { int get() { return lost; } C3 C1x; }", 3, (1, 1, 0, 0, 1)),
        ("p/N.java", None, 0, (0,) * 5), ("p/E.java", "", 0, (0,) * 5), (None, "y x", 2, (0, 0, 0, 0, 2)), (None, "y x", 2, (0, 0, 0, 0, 2))], key=repr)


def test_counts_by_kind_add_up(spark):
    mapping = spark.createDataFrame([("class", "C", "D", 0)], SCHEMA)
    r = apply_job(spark.createDataFrame([("a", "C C C; class X {}")], FILES), mapping).first()
    assert (r["new_text"], r["n_replacements"], r["hits"]["class"]) == ("D D D; class X {}", 3, 3)


def test_single_kinds(spark):
    files = spark.createDataFrame([("p/A.java", "import p.B;\r\nB b = new B();\r\n")], FILES)
    rules = spark.createDataFrame([("p.B", "p.Bee", 0)], "old_key string, new_name string, prio long")
    assert tuple(R.rewrite_imports(files, rules).first())[1:] == (files.first()["text"], "import p.Bee;\r\nB b = new B();\r\n", 1)[0:]
    assert R.rewrite_class_names(files, rules).first()["new_text"] == "import p.Bee;\r\nBee b = new Bee();\r\n"


def test_import_prefixes(spark, size):
    n = 10_000
    pm = spark.range(n).selectExpr("concat('com.a', id) AS old_pkg", "concat('net.b', id) AS new_pkg", "id AS prio")
    pm = pm.unionByName(spark.createDataFrame([("com", "org", 10 ** 6), ("com.a5", "late", 10 ** 7)], "old_pkg string, new_pkg string, prio long"))
    text = "package com.a1;\nimport com.a7.X;\r\nimport static com.a8.Y.f;\nimport com.a8x.Z;\nimport com.a5.*;\n  import com.a9.i.W; // c\nimport com;\nnot import com.a7.X;"
    files = spark.createDataFrame([(None, text), (None, None), (1, "")], "k int, text string")
    got = sorted([(r["new_text"], r["n_import_changes"]) for r in R.rewrite_import_prefix(files, pm, "k").collect()], key=repr)
    want = "package com.a1;\nimport net.b7.X;\r\nimport static net.b8.Y.f;\nimport org.a8x.Z;\nimport net.b5.*;\nimport net.b9.i.W; // c\nimport com;\nnot import com.a7.X;"
    assert got == sorted([(want, 5), (None, 0), ("", 0)], key=repr)


def test_no_text_is_shuffled(spark, tmp_path):
    spark.createDataFrame([("a", "k1 k2"), ("b", "k3")], FILES).write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    rules = spark.createDataFrame([("k%d" % i, "n%d" % i) for i in range(400)], "old_key string, new_name string")
    mapping = rules.selectExpr("'simple' AS kind", "old_key", "new_name", "0L AS prio")
    pm = spark.createDataFrame([("a.b", "c.d", 0)], "old_pkg string, new_pkg string, prio int")
    for df in (R.rewrite_tokens(files, rules), apply_job(files, mapping), R.rewrite_import_prefix(files, pm)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("bound", [0, 1, 30])
def test_frequent_keys_are_constant_and_only_rare_ones_are_joined(spark, monkeypatch, bound):
    monkeypatch.setattr(lookup, "LOOKUP_MAX_ROWS", bound)
    files = spark.createDataFrame([(i, "hot k%d hot" % i, "extra") for i in range(200)], "doc_id long, text string, old_key string")
    rules = spark.createDataFrame([("k%d" % i, "n%d" % i) for i in range(0, 200, 2)] + [("hot", "cold")], "old_key string, new_name string")
    out = R.rewrite_tokens_lookup(files, rules)
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["doc_id"], r["new_text"], r["n_replacements"], r["old_key"]) for r in out.collect()} == {
        (i, "cold %s%d cold" % ("k" if i % 2 else "n", i), 2 + (i + 1) % 2, "extra") for i in range(200)}
    counted = rules.selectExpr("old_key", "new_name", "if(old_key = 'hot', 200, 1) AS _rows")
    assert lookup.frequent_lookup(counted, "old_key", "new_name").empty == (bound == 0)


def test_an_overlong_rule_is_joined(spark):
    files = spark.createDataFrame([(1, "a " + "b" * 1500 + " c")], "doc_id long, text string")
    rules = spark.createDataFrame([("a", "x"), ("b" * 1500, "y"), ("c", "z" * 1500)], "old_key string, new_name string")
    r = R.rewrite_tokens_lookup(files, rules).first()
    assert r["new_text"] == "x y " + "z" * 1500 and r["n_replacements"] == 3


def test_a_row_with_many_rules(spark):
    n = 20_000
    files = spark.createDataFrame([(1, " ".join("k%d" % i for i in range(n)))], "doc_id long, text string")
    rules = spark.range(0, n, 2).selectExpr("concat('k', id) AS old_key", "concat('n', id) AS new_name")
    r = R.rewrite_tokens(files, rules).first()
    assert r["n_replacements"] == n // 2 and r["new_text"] == " ".join(("k%d" if i % 2 else "n%d") % i for i in range(n))


def model(text, rules, owner):
    """The definition in plain Python: one pass, priority by kind."""
    cls = {o.split(".")[-1]: n.split(".")[-1] for k, o, n in rules if k == "class"}
    imp = {o: n for k, o, n in rules if k == "class"}
    met = {o.split("#")[1]: n for k, o, n in rules if k == "method" and o.split("#")[0] == owner}
    fld = {o.split("#")[1]: n for k, o, n in rules if k == "field" and o.split("#")[0] == owner}
    sim = {o: n for k, o, n in rules if k == "simple"}
    token = re.compile(r"([A-Za-z0-9_$]+)([ \t\n\x0b\f\r]*\()?")

    def swap(m):
        t, call = m[1], m[2] or ""
        if t in cls:
            return cls[t] + call
        if call and t in met:
            return met[t] + "("
        return fld.get(t, sim.get(t, t)) + call
    # stretches between renamed import lines are read as one text
    done, buf = [], ""
    for line in re.split(r"(?<=\n)", text):
        m = re.fullmatch(r"[ \t]*import[ \t]+([A-Za-z_$][\w$]*(?:\.[\w$]+)*)[ \t]*;[ \t]*(\r?\n?)", line)
        if m and m[1] in imp:
            done += [token.sub(swap, buf), "import %s;%s" % (imp[m[1]], m[2])]
            buf = ""
        else:
            buf += line
    return "".join(done) + token.sub(swap, buf)


names = st.sampled_from(["a", "b", "C", "D", "p", "x1", "$y"])
rules_st = st.lists(st.tuples(st.sampled_from(["class", "method", "field", "simple"]), names, names), max_size=8, unique_by=lambda r: r[:2])
text_st = st.lists(st.one_of(names, st.sampled_from([" ", "(", ";", "\n", "\r\n", ".", "import p.C;", "import p.D ;\n", "\nimport p.C;\r\n", "é", "=", "  "])),
                   max_size=25).map("".join)


@settings(max_examples=5, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(text_st, min_size=20, max_size=60), rules_st)
def test_equals_the_model(spark, texts, raw):
    rules = [(k, {"class": "p." + o, "simple": o}.get(k, "p.A#" + o), "p." + n if k == "class" else n) for k, o, n in raw if o != n]
    mapping = spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], SCHEMA)
    files = spark.createDataFrame([("p/A.java", t, i) for i, t in enumerate(texts)], "rel_path string, text string, i int")
    got = {r["i"]: r["new_text"] for r in apply_spans(files, mapping).collect()}
    assert got == {i: model(t, rules, "p.A") for i, t in enumerate(texts)}
