"""Scalar functions against plain Python models of their definitions (hypothesis)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from legible.functions import text as T


def trim_model(code, head, tail):
    lines = re.split("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]", code)
    if len(lines) <= head + tail + 5:
        return code
    return "".join(l + "\n" for l in lines[:head]) + "// ... (trimmed) ...\n" + \
        "".join(l + "\n" for l in lines[max(len(lines) - tail, 0):])


def segment_model(s):
    x = re.sub(r"[^A-Za-z0-9]+", "", s)
    x = "pkg" if x.strip() == "" else x
    return x.lower()[:24]


def obfuscated_model(leaf):
    s = leaf.lower()
    return bool(re.fullmatch(r"[a-z]{1,2}\d*|[a-z]\d+|ui\d+|controls\d+", s, re.A))


def payload_model(c):
    f1 = c.find("```")
    if f1 >= 0:
        f2 = c.find("```", f1 + 3)
        if f2 > f1:
            c = c[f1 + 3:f2]
    c = c.strip("".join(chr(i) for i in range(33)))
    so, sa = c.find("{"), c.find("[")
    if sa >= 0 and (so < 0 or sa < so):
        return c[sa:]
    if so >= 0:
        return c[so:]
    return None


LINES = st.lists(st.sampled_from(["", "a", "b c", "  x", "{"]), min_size=0, max_size=40).map("\n".join)
WORDS = st.text(alphabet="aB3_-x .é", max_size=30)
LEAVES = st.sampled_from(["a", "ab", "abc", "a1", "b22", "ui7", "UI7", "controls18", "auth", "x_y", "", "A"])
REPLIES = st.lists(st.sampled_from(["pre ", "```", "json\n", "[1]", '{"a":1}', " ", "\n", "x"]), max_size=8).map("".join)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LINES, min_size=1, max_size=6), st.lists(WORDS, min_size=1, max_size=6),
       st.lists(LEAVES, min_size=1, max_size=6), st.lists(REPLIES, min_size=1, max_size=6))
def test_scalar_models(spark, codes, words, leaves, replies):
    def run(values, fn):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return [r[0] for r in df.select(fn(F.col("v"))).collect()]
    assert run(codes, lambda c: T.trim_head_tail(c, 3, 2)) == [trim_model(c, 3, 2) for c in codes]
    assert run(words, T.sanitize_segment) == [segment_model(w) for w in words]
    assert run(leaves, T.looks_obfuscated) == [obfuscated_model(x) for x in leaves]
    assert run(replies, T.extract_json_payload) == [payload_model(r) for r in replies]


def jtrim(s):
    return s.strip("".join(chr(i) for i in range(33)))


def clean_model(s):
    t = jtrim(s)
    if t.startswith("```"):
        first = t.find("\n")
        if first > 0:
            t = t[first + 1:]
        last = t.rfind("```")
        if last >= 0:
            t = t[:last]
        t = jtrim(t)
    if t.startswith("/**"):
        end = t.rfind("*/")
        if end >= 0:
            t = jtrim(t[3:end])
    out = ""
    for ln in re.split(r"\r?\n", t):
        ln = jtrim(ln)
        if ln.startswith("*"):
            ln = jtrim(ln[1:])
        out += ln + "\n"
    return jtrim(re.sub(r"[ \t\n\x0b\f\r]+\n", "\n", jtrim(out)))


def block_model(main, tags):
    def java_split(x):
        parts = re.split("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]", x)
        if x == "":
            return [""]
        while parts and parts[-1] == "":
            parts.pop()
        return parts
    out = "/**\n"
    for ln in java_split(main):
        out += " *\n" if ln == "" else " * " + jtrim(ln) + "\n"
    if tags:
        for ln in java_split(tags):
            out += (" *" if ln == "" else ln if ln.startswith(" *") else " * " + ln) + "\n"
    return out + " */"


DOCS = st.lists(st.sampled_from(["```", "java", "\n", "/**", "*/", " * ", "*", "Does x.", " ", "\t", "\n\n"]),
                max_size=10).map("".join)
TAGS = st.lists(st.sampled_from([" * @param a parameter\n", "@return r\n", "\n", ""]), max_size=3).map("".join)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(DOCS, min_size=1, max_size=6), st.lists(st.tuples(DOCS, TAGS), min_size=1, max_size=6))
def test_doc_text_models(spark, docs, pairs):
    df = spark.createDataFrame([(d,) for d in docs], "v string")
    assert [r[0] for r in df.select(T.clean_doc_text(F.col("v"))).collect()] == [clean_model(d) for d in docs]
    pf = spark.createDataFrame(pairs, "m string, t string")
    got = [r[0] for r in pf.select(T.doc_block(F.col("m"), F.col("t"))).collect()]
    assert got == [block_model(m, t) for m, t in pairs]


def heuristic_model(snippet, lang, style):
    from legible.operators import heuristics as H
    header = jtrim(snippet.split("\n", 1)[0])
    low = header.lower()
    for kind, pat in (("get", H.GETTER), ("set", H.SETTER), ("is", H.ISSER)):
        m = re.search(pat, header, re.A)
        if m:
            g = m.group(1)
            pretty = "value" if not g else (g[0] + re.sub(r"([A-Z])", r" \1", g[1:])).lower().strip()
            return H.ACCESSOR_TEXT["zh" if lang == "zh" else "en"][kind].replace("%s", pretty)
    msg = H.DEFAULT_TEXT[1 if lang == "zh" else 0]
    for words, en, zh in H.KEYWORD_RULES:
        if any(w in low for w in words):
            msg = zh if lang == "zh" else en
            break
    if style == "detailed":
        msg += H.DETAILED_SUFFIX[1 if lang == "zh" else 0]
    return msg


HEADERS = st.lists(st.sampled_from(["public ", "static ", "@Override ", "String ", "void ", "boolean ", "List<X> ",
                                    "getUserName", "setValue", "isReady", "parseJson", "fetchAll", "init", "close",
                                    "hashCode", "(", ")", " ", "\n body"]), max_size=7).map("".join)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(HEADERS, st.sampled_from(["en", "zh"]), st.sampled_from(["concise", "detailed"])),
                min_size=1, max_size=8))
def test_heuristic_doc_model(spark, rows):
    from legible.operators.heuristics import heuristic_doc
    df = spark.createDataFrame(rows, "s string, l string, st string")
    got = [r[0] for r in df.select(heuristic_doc(F.col("s"), F.col("l"), F.col("st"))).collect()]
    assert got == [heuristic_model(s, l, st) for s, l, st in rows]


def test_clean_doc_text_reads_every_step_once(spark):
    """The steps nest: without names for what they share the plan holds the first one hundreds of times."""
    df = spark.createDataFrame([("x",)], "v string").select(T.clean_doc_text(F.col("v")).alias("c"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("v#") < 10
