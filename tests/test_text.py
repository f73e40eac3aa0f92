"""Scalar text functions on hand-written rows (expected values worked out by hand)."""

from pyspark.sql import functions as F

from legible.functions import text as T


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


def test_approx_tokens(spark):
    assert one(spark, T.approx_tokens, "abcdefg") == 2
    assert one(spark, T.approx_tokens, None) == 0
    assert one(spark, lambda c: T.approx_tokens(c, True), "") == 1


def test_trim_head_tail(spark):
    text = "\n".join("l%d" % i for i in range(30))
    out = one(spark, lambda c: T.trim_head_tail(c, 2, 3), text)
    assert out == "l0\nl1\n// ... (trimmed) ...\nl27\nl28\nl29\n"
    short = "\n".join("l%d" % i for i in range(10))
    assert one(spark, lambda c: T.trim_head_tail(c, 2, 3), short) == short


def test_split_camel_and_segment(spark):
    assert one(spark, T.split_camel, "UserName") == "user name"
    assert one(spark, T.split_camel, "") == "value"
    assert one(spark, T.sanitize_segment, "Foo_Bar-1") == "foobar1"
    assert one(spark, T.sanitize_segment, "__") == "pkg"
    assert one(spark, T.sanitize_segment, "x" * 30) == "x" * 24


def test_normalize_package_and_obfuscated(spark):
    assert one(spark, T.normalize_package, "Com/Foo_1/b/") == "com.foo1.b"
    for leaf, want in [("a", True), ("b2", True), ("ui73", True), ("controls18", True), ("auth", False),
                       ("abc", False), ("ab", True)]:
        assert one(spark, T.looks_obfuscated, leaf) is want, leaf


def test_chat_content_shapes(spark):
    cases = {
        '{"choices":[{"message":{"content":"hi"}}]}': "hi",
        '{"message":{"content":"m"}}': "m",
        '{"response":"r"}': "r",
        '{"choices":[{"text":"t"}]}': "t",
        '{"choices":[{"message":{"content":"a\\nb\\"c': 'a\nb"c',
        "plain": "plain",
    }
    for body, want in cases.items():
        assert one(spark, T.extract_chat_content, body) == want, body


def test_json_payload(spark):
    assert one(spark, T.extract_json_payload, 'pre ```json\n[{"a":1}]\n```') == '[{"a":1}]'
    assert one(spark, T.extract_json_payload, 'x {"renames": []}') == '{"renames": []}'
    assert one(spark, T.extract_json_payload, "no json") is None


def test_clean_doc_and_block(spark):
    assert one(spark, T.clean_doc_text, "```java\n/**\n * Hello.\n *   World  \n */\n```") == "Hello.\nWorld"
    block = spark.createDataFrame([("Does X.\n", " * @param a parameter\n")], "m string, t string").select(
        T.doc_block(F.col("m"), F.col("t")).alias("b")).first()["b"]
    assert block == "/**\n * Does X.\n * @param a parameter\n */"


def test_render_tags(spark):
    df = spark.createDataFrame([(["a", "b"], "int", ["E"], "en"), (["a"], None, [], "zh")],
                               "p array<string>, r string, t array<string>, l string")
    out = [r[0] for r in df.select(T.render_doc_tags("p", "r", "t", "l")).collect()]
    assert out[0] == " * @param a parameter\n * @param b parameter\n * @return return value\n * @throws E possible exception\n"
    assert out[1] == " * @param a 参数\n"


def test_fqn_helpers(spark):
    assert one(spark, T.fqn_from_path, "com/foo/C.java") == "com.foo.C"
    assert one(spark, T.fqn_from_path, "C.java") == "C"
    assert one(spark, T.fqn_from_path, "com\\foo\\C.java") == "com.foo.C"
    assert one(spark, T.simple_name, "a.b.C") == "C"
    assert one(spark, T.parent_name, "a.b.C") == "a.b"


def test_glob(spark):
    assert T.glob_to_regex("**/gen/*.java") == "^.*/gen/[^/]*\\.java$"
    df = spark.createDataFrame([("a/gen/X.java",), ("a/src/X.java",)], "p string")
    kept = [r[0] for r in df.filter(~T.excluded_by("p", ["**/gen/*.java"])).collect()]
    assert kept == ["a/src/X.java"]
