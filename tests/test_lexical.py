"""The lexical mask, behaviour signals and the scanner's structure (faults found in review, kept as tests)."""

import re

from hypothesis import given
from hypothesis import strategies as st
from legible.functions import text as T
from legible.operators import extract as E
from legible.operators.javascan import count_statements, mask, scan_java
from pyspark.sql import functions as F


def _one(spark, code, expr):
    return spark.createDataFrame([(code,)], "code string").select(expr.alias("x")).first()["x"]


def test_literals_next_to_chars_and_comments(spark):
    code = """char q = '"'; String a = "one"; // "no"
/* "no" */ char r = '\\''; s("two\\"x", "one"); t = \"\"\"
 "block" \"\"\"; u = "";"""
    assert _one(spark, code, T.string_literals("code")) == ["one", 'two\\"x', ""]
    assert _one(spark, code, T.string_literals("code", 1)) == ["one"]
    assert _one(spark, None, T.string_literals("code")) == []
    long = '"' + "\\n" * 50_000 + '"'
    assert len(_one(spark, "x = %s;" % long, T.string_literals("code"))[0]) == 100_000


def test_signals(spark):
    code = """{ super(a); this(b); do { go(); } while (x("for (")); for (;;) while (y) z(); // if (no) call()
      if (p) new Thing<Map<A, B>>(q(1)); else switch (r()) { default: } return call (s); }"""
    s = _one(spark, code, E.behavior_signals("code"))
    assert (s["loops"], s["conditionals"]) == (3, 2)
    assert s["calls"] == ["go", "x", "z", "q", "r", "call"]
    assert _one(spark, "{ a(); b(); c(); }", E.behavior_signals("code", max_calls=2)["calls"]) == ["a", "b"]


def test_member_signals(spark):
    files = spark.createDataFrame([("A.java", "class A { int f(int a, B b) throws X, Y { return a; } A() { } }")], "rel_path string, text string")
    s = {r["method_name"]: r["signals"] for r in E.member_signals(E.java_declarations(files)).collect()}
    assert (s["f"]["params"], s["f"]["returns"], s["f"]["throws"], s["f"]["size"]) == (["a", "b"], "int", ["X", "Y"], 1)
    assert s["A"]["returns"] is None and s["A"]["size"] == 0


def test_statements():
    for body, n in [("{ }", 0), ("{ a(); b(); }", 2), ("{ if (a) b(); else c(); d(); }", 2), ("{ int[] x = {1, 2}; }", 1),
                    ("{ run(() -> { a(); b(); }); }", 1), ("{ R r = new R() { void f() { g(); } }; }", 1), ("{ do { a(); } while (b); c(); }", 2),
                    ("{ do a(); while (b); while (c) { d(); } }", 2), ("{ try { a(); } catch (E e) { b(); } finally { c(); } }", 1),
                    ("{ { a(); } { b(); } }", 2), ("{ for (int i = 0; i < 3; i++) { a(); } }", 1), ("{ x = switch (y) { default -> 1; }; }", 1)]:
        assert count_statements(body) == n, body


def _members(text):
    return [(r["unit_kind"], r["class_name"], r["method_name"]) for r in scan_java("X.java", text)]


def test_annotations_with_arguments_inside_arguments():
    got = _members('class A { @Anno(value = @X("b")) void f() { } @B({1, 2}) @C int g(@D(x = "(") int p) { return 1; } }')
    assert got == [("method", "A", "f"), ("method", "A", "g"), ("type", "A", "")]


def test_enum_constants_are_no_methods_and_their_bodies_are_read():
    got = _members("enum E { A, B1(2), C(3) { int z() { return 1; } }; E(int i) { } int z() { return 0; } } enum F { X, Y { void q() { } } }")
    assert got == [("method", "E", "z"), ("ctor", "E", "E"), ("method", "E", "z"), ("type", "E", ""), ("method", "F", "q"), ("type", "F", "")]


def test_an_unknown_member_is_a_row_of_its_own(spark):
    text = "class A { int ok() { return 1; } int 9bad(int a) { return 2; } static { go(); } Runnable r = () -> { go(); }; }"
    rows = scan_java("X.java", text)
    assert [r["unit_kind"] for r in rows] == ["method", "error", "type"]
    assert text[rows[1]["start"]:].startswith("int 9bad")
    decls = E.java_declarations(spark.createDataFrame([("X.java", text), ("Y.java", "class {")], "rel_path string, text string"))
    assert {(r["status"], r["n_files"]) for r in E.scan_totals(decls).collect()} == {("ok", 1), ("fail", 1)}


def test_only_named_kinds_enter_naming(spark):
    files = spark.createDataFrame([("X.java", "enum E { A; void e() { } } record R(int x) { int r() { return x; } } class C { void c() { } }")],
                                  "rel_path string, text string")
    decls = E.java_declarations(files)
    assert [r["method_name"] for r in E.java_units(decls).collect()] == ["c"]
    assert len(E.java_units(decls, naming_kinds=("class", "interface", "enum", "record")).collect()) == 3


def test_unit_code_is_the_declaration_and_the_whole_body(spark):
    body = "{ %s }" % ("x = 1; " * 4000)
    files = spark.createDataFrame([("X.java", "class C { static int f(int a) %s }" % body)], "rel_path string, text string")
    u = E.java_units(E.java_declarations(files)).first()
    assert u["code"] == "int f(int)\n" + body and len(u["code"]) > 12_000


@given(st.lists(st.sampled_from(['"', "'", "\\", "/", "*", "//", "/*", "*/", "\n", "a", "{", '"""', " "]), max_size=30).map("".join))
def test_mask_keeps_every_offset(text):
    m = mask(text)
    assert len(m) == len(text) and all(a == b or (b == " " and a != "\n") for a, b in zip(text, m))
    assert [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(m) if c == "\n"]
    assert not re.search(r'"[^"\\\n]*"', re.sub(r'"""', " ", m))


def test_code_only_agrees_with_the_mask(spark):
    texts = ["a // b\nc", 'x "y" z', "p /* q */ r", "'c' d", 'open "quote', "/* open"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.code_only(F.col("t"))).collect()]
    assert [g.split() for g in got] == [mask(t).split() for t in texts]
