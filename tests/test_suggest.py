"""Mapping resolution on a hand-made unit set (first-wins, allowed keys, fills, heuristic pool)."""

from pyspark.sql import functions as F

from legible.operators import suggest as S
from legible.plans.catalog_more import conversation_units  # noqa: F401  (import check)

UNITS = [
    # unit_order, pkg, class_name, method_name, params, unit_kind, decl, code
    (0, "demo.mix", "a", "h", ["String"], "method", "h(String)", "int v0 = x + 1; return v0;"),
    (1, "demo.mix", "a", "a", [], "ctor", "a()", "{}"),
    (2, "demo.mix", "w0", "K", [], "method", "K()", "return get(k);"),
    (3, "", "z0", "main", ["String[]"], "method", "main(String[])", "put(x);"),
]


def units(spark):
    df = spark.createDataFrame(UNITS, "unit_order bigint, pkg string, class_name string, method_name string, "
                                      "param_types array<string>, unit_kind string, decl string, code string")
    from legible.functions import text as T
    return (df.withColumn("class_fqn", T.class_fqn("pkg", "class_name"))
              .withColumn("qualified_signature", T.qualified_signature("pkg", "class_name", "method_name", "param_types")))


def sugg(spark, rows):
    return spark.createDataFrame(rows, "batch_id bigint, pos bigint, kind string, old string, new string")


def test_first_wins_and_rejects(spark):
    s = sugg(spark, [(0, 0, "class", "a", "Hasher"), (1, 0, "class", "a", "Other"), (0, 1, "method", "h", "hash"),
                     (0, 2, None, "x", "y"), (0, 3, "var", "v0", "  "), (2, 0, "var", "v0", "count")])
    m = {(r.kind, r.old_key): r.new_name for r in S.suggestions_to_mapping(s, units(spark)).collect()}
    assert m[("class", "demo.mix.a")] == "demo.mix.Hasher"
    assert m[("method", "demo.mix.a.h(String)")] == "hash"
    assert m[("simple", "v0")] == "count"
    valid, rejected = S.valid_suggestions(s)
    assert rejected.count() == 2


def test_restrict_and_fill(spark):
    u = units(spark)
    keys = S.allowed_keys(u)
    mapping = spark.createDataFrame([("class", "demo.mix.a", "demo.mix.Hasher", 0), ("class", "nope.X", "Y", 1),
                                     ("simple", "do", "act", 2), ("simple", "qq", "zz", 3)],
                                    "kind string, old_key string, new_name string, prio bigint")
    r = S.restrict_to_allowed(mapping, keys).collect()
    assert [(x.kind, x.old_key) for x in r] == [("class", "demo.mix.a")]
    filled = S.fallback_fill(spark.createDataFrame(r), u, keys).collect()
    meth = {x.old_key: x.new_name for x in filled if x.kind == "method"}
    assert meth["demo.mix.a.h(String)"] == "add" and meth["demo.mix.w0.K()"] == "get" and meth["z0.main(String[])"] == "put"
    simple = [(x.old_key, x.new_name) for x in filled if x.kind == "simple"]
    assert simple[:2] == [("h", "value"), ("v0", "sum")]


def test_heuristic_pool_and_getters(spark):
    h = S.heuristic_names(units(spark)).collect()
    simple = {r.old_key: r.new_name for r in h if r.kind == "simple"}
    assert simple["a"] == "value" and simple["h"] == "tmp"           # ties broken by token
    meth = {r.old_key: r.new_name for r in h if r.kind == "method"}
    assert meth == {"demo.mix.a.h(String)": "geta", "demo.mix.w0.K()": "getw0"} or "demo.mix.w0.K()" in meth
    parity = {r.old_key for r in S.heuristic_names(units(spark), parity=True).collect() if r.kind == "method"}
    assert "demo.mix.a" in parity or "demo.mix.a.a()" in parity    # constructors join in parity mode
