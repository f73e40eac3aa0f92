"""Scalar text helpers: every function maps Columns to a Column of native Spark expressions.

Nothing here leaves the JVM, so all of it stays inside whole-stage code generation.
Lengths are counted in code points (Spark's ``length``), not UTF-16 units.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's behaviour ---------------------------------
TRIM_MARKER = "// ... (trimmed) ..."        # line inserted between head and tail
TRIM_SLACK = 5                              # texts with <= head + tail + 5 lines stay whole
CHARS_PER_TOKEN = 3.5                       # token estimate: ceil(chars / 3.5)
SNIPPET_CAP = 12000                         # default cap of a unit's text
ERROR_CAP = 300                             # squashed error text length before "..."
SEGMENT_CAP = 24                            # longest package segment
# ----------------------------------------------------------------------------------------------

# Java identifier characters as the rewriting rules see them (ASCII word chars plus '$').
IDENT_CLASS = "A-Za-z0-9_$"
# Whitespace as Java's \s sees it (RE2 lacks \x0B inside \s, so spell it out everywhere).
WS_CLASS = "[ \\t\\n\\x0B\\f\\r]"
# Characters Java's String.trim() removes.
JTRIM = "^[\\x00-\\x20]+|[\\x00-\\x20]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def java_trim(c) -> Column:
    """``String.trim()``: strip every char <= U+0020 at both ends."""
    return F.regexp_replace(_c(c), JTRIM, "")


# T1
def approx_tokens(c, at_least_one: bool = False) -> Column:
    n = F.ceil(F.length(F.coalesce(_c(c), F.lit(""))) / F.lit(CHARS_PER_TOKEN)).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), n) if at_least_one else n


def _lines(c) -> Column:
    """Split on any line break, keeping trailing empty lines (split limit -1)."""
    return F.split(F.coalesce(_c(c), F.lit("")), "\\R", -1)


def _with_nl(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: F.concat(x, F.lit("\n"))), "")


# T2
def trim_head_tail(c, head: int = 50, tail: int = 50) -> Column:
    """Keep the first ``head`` and last ``tail`` lines around a marker line."""
    src = F.coalesce(_c(c), F.lit(""))
    lines = _lines(src)
    n = F.size(lines)
    cut = F.concat(
        _with_nl(F.slice(lines, 1, head)) if head > 0 else F.lit(""),
        F.lit(TRIM_MARKER + "\n"),
        _with_nl(F.slice(lines, n - F.lit(tail) + 1, F.lit(tail))) if tail > 0 else F.lit(""),
    )
    return F.when(n <= head + tail + TRIM_SLACK, src).otherwise(cut)


# T3
def strip_control(c) -> Column:
    return F.regexp_replace(_c(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")


# T4
def squash_error_text(c, n: int = ERROR_CAP) -> Column:
    s = F.regexp_replace(F.coalesce(_c(c), F.lit("")), WS_CLASS + "+", " ")
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


# T5
def first_line(c) -> Column:
    return F.substring_index(_c(c), "\n", 1)


# T6
def split_camel(c) -> Column:
    """``UserName`` -> ``user name``; null or empty -> ``value``."""
    s = _c(c)
    spaced = F.concat(F.substring(s, 1, 1),
                      F.regexp_replace(F.substring(s, 2, 1 << 30), "(\\p{Lu})", " $1"))
    return F.when(s.isNull() | (s == ""), F.lit("value")).otherwise(F.trim(F.lower(spaced)))


# T7
def sanitize_segment(c) -> Column:
    x = F.regexp_replace(_c(c), "[^A-Za-z0-9]+", "")
    x = F.when(_c(c).isNull() | (java_trim(x) == ""), F.lit("pkg")).otherwise(x)
    return F.substring(F.lower(x), 1, SEGMENT_CAP)


# T8
def normalize_package(path) -> Column:
    """Folder path ``Com/Foo_1/b`` -> package ``com.foo1.b`` (trailing separators dropped)."""
    p = F.regexp_replace(F.regexp_replace(_c(path), "[\\\\/]", "."), "\\.+$", "")
    segs = F.split(p, "\\.", -1)
    return F.array_join(F.transform(segs, lambda s: F.lower(F.regexp_replace(s, "[^a-zA-Z0-9]", ""))), ".")


# T9
OBFUSCATED_LEAF = "^([a-z]{1,2}[0-9]*|[a-z][0-9]+|ui[0-9]+|controls[0-9]+)$"


def looks_obfuscated(leaf) -> Column:
    return F.coalesce(F.lower(_c(leaf)).rlike(OBFUSCATED_LEAF), F.lit(False))


def _unescape_json_fragment(s: Column) -> Column:
    """Hand-rolled unescape of a broken body: ``\\n``/``\\t`` become breaks, ``\\x`` becomes x."""
    toks = F.regexp_extract_all(s, F.lit("\\\\.|[^\\\\]+"), 0)
    return F.array_join(F.transform(toks, lambda t: (
        F.when(t == "\\n", F.lit("\n"))
         .when(t == "\\t", F.lit("\t"))
         .when(F.startswith(t, F.lit("\\")), F.substring(t, 2, 1))
         .otherwise(t))), "")


# T10
def extract_chat_content(body) -> Column:
    """Reply text of a chat body: choices[0].message.content, message.content, response,
    choices[0].text, else the raw body; a body that is not JSON falls back to the last
    ``"content":"…"`` fragment."""
    b = _c(body)
    parsed = F.coalesce(
        F.get_json_object(b, "$.choices[0].message.content"),
        F.get_json_object(b, "$.message.content"),
        F.get_json_object(b, "$.response"),
        F.get_json_object(b, "$.choices[0].text"),
    )
    is_json = F.get_json_object(b, "$").isNotNull()
    frag = F.regexp_extract(b, '(?s).*"content":"((?:[^"\\\\]|\\\\.)*)', 1)
    broken = F.when(F.instr(b, '"content":"') > 0, _unescape_json_fragment(frag)).otherwise(b)
    return F.when(is_json, F.coalesce(parsed, b)).otherwise(broken)


# T11
def extract_json_payload(content) -> Column:
    """Drop a code fence (with or without a tag) and cut from the first ``[`` or ``{``."""
    c = F.coalesce(_c(content), F.lit(""))
    f1 = F.instr(c, "```")
    after = F.substring(c, f1 + 3, 1 << 30)
    f2 = F.instr(after, "```")
    cleaned = java_trim(F.when((f1 > 0) & (f2 > 0), F.substring(after, 1, f2 - 1)).otherwise(c))
    s_obj = F.instr(cleaned, "{")
    s_arr = F.instr(cleaned, "[")
    return (F.when((s_arr > 0) & ((s_obj == 0) | (s_arr < s_obj)), F.substring(cleaned, s_arr, 1 << 30))
             .when(s_obj > 0, F.substring(cleaned, s_obj, 1 << 30)))


# T12
def clean_doc_text(c) -> Column:
    """Strip a fence, a ``/** */`` shell, leading ``*`` per line and blanks before breaks.

    Every step reads its predecessor's text several times, so each is computed once (``let``)."""
    def unfenced(t):
        # fence: drop the first line, cut at the last fence
        nl = F.instr(t, "\n")
        body = F.when(nl > 0, F.substring(t, nl + 1, 1 << 30)).otherwise(t)

        def cut(b):
            return let(F.locate("```", F.reverse(b)), lambda at: F.when(at > 0, F.substring(b, F.lit(1), F.length(b) - at - 2)).otherwise(b))
        return F.when(F.startswith(t, F.lit("```")), java_trim(let(body, cut))).otherwise(t)

    def unshelled(t):
        # /** ... */ shell; ``at`` is that of the last "*/" from the end
        inner = let(F.locate("/*", F.reverse(t)), lambda at: F.when(at > 0, java_trim(F.substring(t, F.lit(4), F.length(t) - at - 4))).otherwise(t))
        return F.when(F.startswith(t, F.lit("/**")), inner).otherwise(t)

    def line(ln):
        return F.when(F.startswith(ln, F.lit("*")), java_trim(F.substring(ln, 2, 1 << 30))).otherwise(ln)

    t = let(let(java_trim(F.coalesce(_c(c), F.lit(""))), unfenced), unshelled)
    lines = F.transform(F.split(t, "\\r?\\n", -1), lambda ln: let(java_trim(ln), line))
    t = java_trim(_with_nl(lines))
    return java_trim(F.regexp_replace(t, WS_CLASS + "+\\n", "\n"))


# T13 (fixed tag wording, English and Chinese)
TAG_TEXT = {
    "en": {"param": " parameter", "return": " * @return return value\n", "throws": " possible exception"},
    "zh": {"param": " 参数", "return": " * @return 返回值\n", "throws": " 可能抛出的异常"},
}


def render_doc_tags(params, returns, throws, lang) -> Column:
    """``@param``/``@return``/``@throws`` lines; ``returns`` null for constructors."""
    lang_c = _c(lang) if not isinstance(lang, str) or lang not in TAG_TEXT else F.lit(lang)

    def pick(key):
        return F.when(lang_c == "zh", F.lit(TAG_TEXT["zh"][key])).otherwise(F.lit(TAG_TEXT["en"][key]))

    p = F.array_join(F.transform(F.coalesce(_c(params), F.array().cast("array<string>")),
                                 lambda x: F.concat(F.lit(" * @param "), x, pick("param"), F.lit("\n"))), "")
    r = F.when(_c(returns).isNotNull() & (_c(returns) != "void"), pick("return")).otherwise(F.lit(""))
    t = F.array_join(F.transform(F.coalesce(_c(throws), F.array().cast("array<string>")),
                                 lambda x: F.concat(F.lit(" * @throws "), x, pick("throws"), F.lit("\n"))), "")
    return F.concat(p, r, t)


def _java_split_lines(s: Column) -> Column:
    """``s.split("\\R")``: trailing empty strings removed, ``""`` gives ``[""]``."""
    stripped = F.regexp_replace(s, "\\R+$", "")
    return (F.when(s == "", F.array(F.lit("")))
             .when(stripped == "", F.array().cast("array<string>"))
             .otherwise(F.split(stripped, "\\R", -1)))


# T14
def doc_block(main, tags) -> Column:
    m = F.coalesce(_c(main), F.lit(""))
    main_lines = F.transform(_java_split_lines(m), lambda ln: F.when(ln == "", F.lit(" *"))
                             .otherwise(F.concat(F.lit(" * "), java_trim(ln))))
    tg = F.coalesce(_c(tags), F.lit(""))
    tag_lines = F.transform(_java_split_lines(tg), lambda ln: F.when(ln == "", F.lit(" *"))
                            .when(F.startswith(ln, F.lit(" *")), ln)
                            .otherwise(F.concat(F.lit(" * "), ln)))
    tag_lines = F.when(tg == "", F.array().cast("array<string>")).otherwise(tag_lines)
    return F.concat(F.lit("/**\n"), _with_nl(main_lines), _with_nl(tag_lines), F.lit(" */"))


# T15
def json_request(system, user, model, max_tokens: int, temperature: float = 0.2) -> Column:
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), _c(system).alias("content")),
        F.struct(F.lit("user").alias("role"), _c(user).alias("content")),
    )
    return F.to_json(F.struct(
        (F.lit(model) if isinstance(model, str) else model).alias("model"),
        msgs.alias("messages"),
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).alias("max_tokens"),
    ))


# E7
def class_fqn(pkg, class_name) -> Column:
    p = F.coalesce(_c(pkg), F.lit(""))
    return F.when(p == "", _c(class_name)).otherwise(F.concat(p, F.lit("."), _c(class_name)))


def qualified_signature(pkg, class_name, method_name, param_types) -> Column:
    fqn = class_fqn(pkg, class_name)
    m = F.coalesce(_c(method_name), F.lit(""))
    return F.when(m == "", fqn).otherwise(
        F.concat(fqn, F.lit("."), m, F.lit("("), F.concat_ws(",", _c(param_types)), F.lit(")")))


# E8
def truncate_text(c, n: int = SNIPPET_CAP) -> Column:
    return F.substring(F.coalesce(_c(c), F.lit("")), 1, n)


# What is not code, recognised from left to right in one alternation: line comment, block comment, text block, string,
# char.  Possessive loops: linear, and no regex recursion on long literals.  Valid in Java's and in Python's syntax.
LEXEME = "|".join((r"//[^\n]*+", r"/\*(?s:.*?)(?:\*/|(?![\s\S]))", r'"""[^"\\]*+(?:(?:\\(?s:.)|"(?!""))[^"\\]*+)*+"""',
                   r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"))


def code_only(code) -> Column:
    """Code with every comment and literal replaced by a blank."""
    return F.regexp_replace(F.coalesce(_c(code), F.lit("")), LEXEME, " ")


# E9
def string_literals(code, limit: int | None = None) -> Column:
    """Distinct string literals in order (text blocks, chars and comments are none); all of them unless ``limit`` is given."""
    found = F.filter(F.regexp_extract_all(F.coalesce(_c(code), F.lit("")), F.lit(LEXEME), 0),
                     lambda x: F.startswith(x, F.lit('"')) & ~F.startswith(x, F.lit('"""')))
    lits = F.array_distinct(F.transform(found, lambda x: F.substr(x, F.lit(2), F.length(x) - 2)))
    return lits if limit is None else F.slice(lits, 1, limit)


# G9
def string_hint(strings, n: int = 8) -> Column:
    return F.array_join(F.slice(_c(strings), 1, n), " | ")


# E15
def simple_name(c) -> Column:
    return F.substring_index(_c(c), ".", -1)


def parent_name(c) -> Column:
    return F.regexp_replace(_c(c), "\\.?[^.]*$", "")


# E16
def fqn_from_path(rel) -> Column:
    """``com/foo/C.java`` -> ``com.foo.C``; backslashes accepted; root files keep their base name."""
    u = F.regexp_replace(_c(rel), "\\\\", "/")
    base = F.regexp_replace(F.substring_index(u, "/", -1), "\\.java$", "")
    d = F.regexp_replace(F.regexp_replace(u, "/?[^/]*$", ""), "/", ".")
    return F.when(u.isNull(), F.lit(None)).when(d == "", base).otherwise(F.concat(d, F.lit("."), base))


# S2
def ext_of(path) -> Column:
    name = F.substring_index(_c(path), "/", -1)
    return F.lower(F.regexp_extract(name, "\\.[^.]*$", 0))


def relative_path(path, root: str) -> Column:
    """Path below ``root``; scheme and authority are ignored on both sides (``file:///r``, ``hdfs:///r``, ``/r``)."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    r = re.sub(scheme, "", root).rstrip("/") + "/"
    p = F.regexp_replace(_c(path), scheme, "")
    return F.when(F.startswith(p, F.lit(r)), F.substring(p, len(r) + 1, 1 << 30)).otherwise(p)


def glob_to_regex(glob: str) -> str:
    """Translate a path glob (``*``, ``**``, ``?``, ``{a,b}``, ``[..]``) to an anchored regex."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            if glob[i + 1:i + 2] == "*":
                out.append(".*")
                i += 1
            else:
                out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}" and depth:
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        elif ch == "[":
            j = glob.find("]", i)
            if j < 0:
                out.append("\\[")
            else:
                body = glob[i + 1:j].replace("\\", "\\\\")
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body + "]")
                i = j
        else:
            out.append("\\" + ch if ch in ".+()|^$\\" else ch)
        i += 1
    return "^" + "".join(out) + "$"


# S3
def excluded_by(rel_path, globs: list[str]) -> Column:
    if not globs:
        return F.lit(False)
    return _c(rel_path).rlike("|".join("(?:%s)" % glob_to_regex(g) for g in globs))
