"""Registered queries over the driver's tables, each with its DuckDB oracle.

Binding (see README): ``documents`` plays the source-file table (``source`` = package, non-empty
lines = code units), ``conversations`` plays ordered snippets to pack and prompt, ``pages.url``
plays the folder tree and ``labels`` plays the resume ledger / labelled subset.  Every query reads
whole tables; the only limits are the operators' own top-k cuts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legible.functions import text as T
from legible.operators import suggest as S
from legible.operators import rewrite as R
from legible.operators.extract import line_units
from legible.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def docs(spark, d, *cols):
    return table(spark, d, "documents", *(cols or ("doc_id", "text", "lang", "source")))


# ============================================================ tokens, pool names, rewriting

SQL_COUNTS = r"""
SELECT token, count(*)::BIGINT AS cnt
FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]')) AS token FROM documents)
WHERE regexp_full_match(token, '[a-z]{1,2}[0-9]?')
GROUP BY token"""

SQL_TOP = """
SELECT (row_number() OVER (ORDER BY cnt DESC, token ASC) - 1)::BIGINT AS rnk, token, cnt
FROM (%s) c ORDER BY cnt DESC, token ASC LIMIT 32""" % SQL_COUNTS

_POOL_SQL = "[" + ",".join("'%s'" % p for p in S.NAME_POOL) + "]"

SQL_POOL = """
SELECT token, new_name, rnk FROM (
  SELECT token, rnk, %s[(rnk %% 16) + 1] || CASE WHEN rnk // 16 = 0 THEN '' ELSE (rnk // 16)::VARCHAR END AS new_name
  FROM (%s) t) p
WHERE token <> new_name""" % (_POOL_SQL, SQL_TOP)


def _pool(spark, d) -> DataFrame:
    return S.pool_names(S.top_tokens(S.short_token_counts(docs(spark, d, "text"), "text")))


@register("short_token_counts", SQL_COUNTS)
def q_short_token_counts(spark, d):
    return S.short_token_counts(docs(spark, d, "text"), "text")


@register("top_tokens", SQL_TOP)
def q_top_tokens(spark, d):
    return S.top_tokens(S.short_token_counts(docs(spark, d, "text"), "text")).select("rnk", "token", "cnt")


@register("pool_names", SQL_POOL)
def q_pool_names(spark, d):
    return _pool(spark, d)


SQL_REWRITE_BASE = """
WITH pool AS (%s),
m AS (SELECT map_from_entries(list({'k': token, 'v': new_name})) AS mp FROM pool),
d AS (SELECT doc_id, source, text, regexp_extract_all(text, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+') AS toks FROM documents),
rw AS (
  SELECT d.doc_id, d.source, d.text,
         array_to_string(list_transform(d.toks, lambda x: coalesce(m.mp[x], x)), '') AS new_text,
         len(list_filter(d.toks, lambda x: m.mp[x] IS NOT NULL))::BIGINT AS n_replacements
  FROM d CROSS JOIN m)""" % SQL_POOL


def _rewritten(spark, d) -> DataFrame:
    pool = _pool(spark, d).select(F.col("token").alias("old_key"), "new_name")
    return R.rewrite_tokens(docs(spark, d, "doc_id", "source", "text"), pool)


@register("rewrite_tokens", SQL_REWRITE_BASE + " SELECT doc_id, new_text, n_replacements FROM rw")
def q_rewrite_tokens(spark, d):
    return _rewritten(spark, d).select("doc_id", "new_text", "n_replacements")


@register("rewrite_totals", SQL_REWRITE_BASE + """
SELECT source, count(*)::BIGINT AS n_files, sum(CASE WHEN new_text IS DISTINCT FROM text THEN 1 ELSE 0 END)::BIGINT AS n_changed,
       sum(n_replacements)::BIGINT AS n_replacements FROM rw GROUP BY source""")
def q_rewrite_totals(spark, d):
    return R.rewrite_totals(_rewritten(spark, d), ["source"])


@register("changed_only", SQL_REWRITE_BASE + " SELECT doc_id, n_replacements FROM rw WHERE new_text IS DISTINCT FROM text")
def q_changed_only(spark, d):
    rw = _rewritten(spark, d)
    return rw.filter(~F.col("new_text").eqNullSafe(F.col("text"))).select("doc_id", "n_replacements")


@register("count_replacements", """
WITH pool AS (%s)
SELECT doc_id, tok AS old_key, count(*)::BIGINT AS hits
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+')) AS tok FROM documents)
WHERE tok IN (SELECT token FROM pool)
GROUP BY doc_id, tok""" % SQL_POOL)
def q_count_replacements(spark, d):
    pool = _pool(spark, d).select(F.col("token").alias("old_key"))
    return R.count_replacements(docs(spark, d, "doc_id", "text"), pool)


# Three fixed rules applied one after another (the second consumes the first's output)
CASCADE_RULES = [("de", "of"), ("of", "tmp"), ("la", "the")]


def _sql_cascade(expr: str) -> str:
    # RE2 has no look-around: a boundary is a captured neighbour; two passes catch neighbours
    # that the first pass consumed ("de de").
    for old, new in CASCADE_RULES:
        for _ in range(2):
            expr = "regexp_replace(%s, '(^|[^A-Za-z0-9_$])%s([^A-Za-z0-9_$]|$)', '\\1%s\\2', 'g')" % (expr, old, new)
    return expr


@register("rewrite_cascade", "SELECT doc_id, %s AS new_text FROM documents" % _sql_cascade("text"))
def q_rewrite_cascade(spark, d):
    rules = [{"kind": "simple", "old": o, "new": n, "prio": i} for i, (o, n) in enumerate(CASCADE_RULES)]
    return docs(spark, d, "doc_id", "text").select("doc_id", R.rewrite_cascade("text", rules).alias("new_text"))


# ============================================================ allowed keys

@register("allowed_simple_keys", r"""
WITH u AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (
    SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE l[i] <> ''),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[A-Za-z]+') AS words, line FROM u),
parts AS (
  SELECT doc_id, line_no, 0 AS part,
         lower(coalesce(words[1], '')) || '(' || array_to_string(words[2:3], ',') || ')' AS t FROM w
  UNION ALL SELECT doc_id, line_no, 1 AS part, line AS t FROM w),
toks AS (
  SELECT doc_id, line_no, part, tok FROM (
    SELECT doc_id, line_no, part, unnest(regexp_split_to_array(t, '[^\p{L}\p{Nd}_]')) AS tok FROM parts)
  WHERE regexp_full_match(tok, '[a-z]{1,2}[0-9]?'))
SELECT tok AS key, min(doc_id)::BIGINT AS first_doc_id, count(DISTINCT doc_id)::BIGINT AS n_docs
FROM toks GROUP BY tok""")
def q_allowed_simple_keys(spark, d):
    units = line_units(docs(spark, d, "doc_id", "text", "source"))
    decl = units.select("doc_id", F.explode(S.short_idents_unicode("decl")).alias("key"))
    code = units.select("doc_id", F.explode(S.short_idents_unicode("code")).alias("key"))
    return decl.unionByName(code).groupBy("key").agg(
        F.min("doc_id").cast("bigint").alias("first_doc_id"),
        F.countDistinct("doc_id").cast("bigint").alias("n_docs"))


# ============================================================ scalar text functions

def _scalar(name: str, spark_expr, sql_expr: str):
    """A scalar text function applied to every document: ``doc_id, value``."""
    register(name, "SELECT doc_id, %s AS value FROM documents" % sql_expr)(
        lambda spark, d: table(spark, d, "documents", "doc_id", "text").select(
            "doc_id", spark_expr(F.col("text")).alias("value")))


_scalar("approx_tokens", T.approx_tokens, "ceil(length(coalesce(text, '')) / 3.5)::BIGINT")
_scalar("truncate_text", T.truncate_text, "substr(coalesce(text, ''), 1, %d)" % T.SNIPPET_CAP)
_scalar("first_line", T.first_line, "split_part(text, chr(10), 1)")
_scalar("trim_head_tail", lambda c: T.trim_head_tail(c, 10, 10), r"""
CASE WHEN len(string_split(text, chr(10))) <= 25 THEN text ELSE
  array_to_string(list_transform(string_split(text, chr(10))[1:10], lambda x: x || chr(10)), '') ||
  '// ... (trimmed) ...' || chr(10) ||
  array_to_string(list_transform(string_split(text, chr(10))[-10:], lambda x: x || chr(10)), '') END""")
_scalar("strip_control", lambda c: T.strip_control(F.replace(F.replace(c, F.lit("a"), F.lit("\x01")),
                                                             F.lit("e"), F.lit("\x0b"))),
        r"regexp_replace(replace(replace(text, 'a', chr(1)), 'e', chr(11)), '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g')")
_scalar("squash_error_text", T.squash_error_text, r"""
CASE WHEN length(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) > 300
     THEN substr(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), 1, 300) || '...'
     ELSE regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') END""")


def _camel_src(c):
    ws = F.slice(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), 0), 1, 3)
    return F.array_join(F.transform(ws, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                           F.lower(F.substring(w, 2, 1 << 30)))), "")


@register("split_camel", r"""
SELECT doc_id, CASE WHEN cw IS NULL OR cw = '' THEN 'value' ELSE
  trim(lower(substr(cw, 1, 1) || regexp_replace(substr(cw, 2), '(\p{Lu})', ' \1', 'g'))) END AS value
FROM (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+')[1:3],
        lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS cw FROM documents)""")
def q_split_camel(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", T.split_camel(_camel_src(F.col("text"))).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from legible.plans import catalog_more  # noqa: F401  (registers the remaining queries)
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from legible.plans import catalog_more  # noqa: F401
    return dict(ORACLE)
