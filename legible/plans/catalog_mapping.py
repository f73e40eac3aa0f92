"""Mapping resolution, docs, folders, ledger and span queries (registered on import)."""

from __future__ import annotations

from pyspark.sql import functions as F

from legible.functions import text as T
from legible.operators import folders as FO
from legible.operators import infer as I
from legible.operators import rewrite as R
from legible.operators import suggest as S
from legible.operators.extract import line_units
from legible.operators.heuristics import (ACCESSOR_TEXT, DEFAULT_TEXT, DETAILED_SUFFIX, GETTER, ISSER,
                                          KEYWORD_RULES, SETTER, heuristic_doc)
from legible.operators.lookup import let
from legible.operators.pack import pack_by_budget
from legible.session import checkpoint_dir, cut_lineage
from legible.plans.catalog import SQL_POOL, _pool, docs, register
from legible.plans.catalog_more import PACK_BUDGET, PACK_MAX, SQL_LINES, SQL_PACK
from legible.sources.tables import table

# ============================================================ suggestions -> mapping
# Labelled documents act as model batches (batch_id = doc_id); each yields five suggestions,
# two of which are invalid (null kind, blank new name).


def _suggestions(spark, d):
    lab = table(spark, d, "labels", "doc_id")
    ds = docs(spark, d, "doc_id", "text").join(lab, "doc_id", "left_semi")
    # first ASCII word only: regexp_extract stops at the first match instead of listing every word
    first = F.regexp_extract("text", "[A-Za-z]+", 0)
    w1 = F.when(first == "", F.lit("x")).otherwise(F.lower(first))
    idc = F.col("doc_id").cast("string")
    rows = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("class").alias("kind"),
                 F.concat(F.lit("Doc"), (F.col("doc_id") % 50).cast("string")).alias("old"),
                 F.concat(F.lit("Page"), idc).alias("new")),
        F.struct(F.lit(1).alias("pos"), F.lit("method").alias("kind"), w1.alias("old"),
                 F.concat(F.lit("handle"), idc).alias("new")),
        F.struct(F.lit(2).alias("pos"), F.lit("var").alias("kind"), F.substring(w1, 1, 2).alias("old"),
                 F.concat(F.lit("v"), idc).alias("new")),
        F.struct(F.lit(3).alias("pos"), F.lit(None).cast("string").alias("kind"), w1.alias("old"),
                 F.concat(F.lit("n"), idc).alias("new")),
        F.struct(F.lit(4).alias("pos"), F.lit("field").alias("kind"), w1.alias("old"), F.lit("  ").alias("new")))
    return ds.select(F.col("doc_id").alias("batch_id"), F.explode(rows).alias("s")).select(
        "batch_id", F.col("s.pos").cast("bigint").alias("pos"), "s.kind", "s.old", "s.new")


def _units(spark, d):
    return line_units(docs(spark, d, "doc_id", "text", "source"))


SQL_SUGG = SQL_LINES + r""",
lw AS (SELECT d.doc_id, coalesce(lower(regexp_extract_all(d.text, '[A-Za-z]+')[1]), 'x') AS w1
       FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)),
sugg AS (
  SELECT doc_id AS batch_id, 0 AS pos, 'class' AS kind, 'Doc' || (doc_id %% 50) AS old, 'Page' || doc_id AS new FROM lw
  UNION ALL SELECT doc_id, 1, 'method', w1, 'handle' || doc_id FROM lw
  UNION ALL SELECT doc_id, 2, 'var', substr(w1, 1, 2), 'v' || doc_id FROM lw
  UNION ALL SELECT doc_id, 3, NULL, w1, 'n' || doc_id FROM lw
  UNION ALL SELECT doc_id, 4, 'field', w1, '  ' FROM lw),
valid AS (SELECT *, batch_id * 1048576 + pos AS o FROM sugg
          WHERE kind IN ('class', 'method', 'field', 'var') AND old IS NOT NULL AND new IS NOT NULL
            AND regexp_replace(new, '\s+', '', 'g') <> ''),
uu AS (SELECT doc_id, line_no, source AS pkg, 'Doc' || doc_id AS class_name, source || '.Doc' || doc_id AS class_fqn,
              method_name, line AS code, doc_id * 1000000 + line_no AS unit_order,
              method_name || '(' || array_to_string(params, ',') || ')' AS decl,
              CASE WHEN method_name = '' THEN source || '.Doc' || doc_id
                   ELSE source || '.Doc' || doc_id || '.' || method_name || '(' || array_to_string(params, ',') || ')'
              END AS qualified_signature FROM units),
fc AS (SELECT old, arg_min(new, o) AS new_name, min(o) AS o FROM valid WHERE kind = 'class' GROUP BY old),
cls AS (SELECT u.class_fqn AS old_key,
               arg_min(CASE WHEN u.pkg = '' THEN fc.new_name ELSE u.pkg || '.' || fc.new_name END, fc.o) AS new_name,
               min(fc.o) AS o
        FROM (SELECT DISTINCT class_name, class_fqn, pkg FROM uu) u JOIN fc ON u.class_name = fc.old GROUP BY u.class_fqn),
fm AS (SELECT old, arg_min(new, o) AS new_name, min(o) AS o FROM valid WHERE kind = 'method' GROUP BY old),
meth AS (SELECT u.qualified_signature AS old_key, arg_min(fm.new_name, fm.o) AS new_name, min(fm.o) AS o
         FROM (SELECT DISTINCT method_name, qualified_signature FROM uu) u JOIN fm ON u.method_name = fm.old
         GROUP BY u.qualified_signature),
simp AS (SELECT old AS old_key, arg_min(new, o) AS new_name, min(o) AS o FROM valid
         WHERE kind IN ('field', 'var') GROUP BY old),
mapping AS (SELECT 'class' AS kind, old_key, new_name FROM cls UNION ALL SELECT 'method', old_key, new_name FROM meth
            UNION ALL SELECT 'simple', old_key, new_name FROM simp),
ptoks AS (
  SELECT unit_order, part, i - 1 AS p, toks[i] AS key FROM (
    SELECT unit_order, part, toks, unnest(generate_series(1, len(toks))) AS i FROM (
      SELECT unit_order, part, list_filter(regexp_split_to_array(t, '[^\p{L}\p{Nd}_]'),
                                           lambda x: regexp_full_match(x, '[a-z]{1,2}[0-9]?')) AS toks
      FROM (SELECT unit_order, 0 AS part, decl AS t FROM uu UNION ALL SELECT unit_order, 1, code FROM uu))
    WHERE len(toks) > 0)),
allowed_simple AS (SELECT key, min((unit_order, part, p)) AS first_order FROM ptoks GROUP BY key),
restricted AS (
  SELECT kind, old_key, new_name FROM mapping
  WHERE regexp_replace(new_name, '\s+', '', 'g') <> ''
    AND ((kind = 'class' AND old_key IN (SELECT class_fqn FROM uu))
      OR (kind = 'method' AND old_key IN (SELECT qualified_signature FROM uu))
      OR (kind = 'simple' AND old_key IN (SELECT key FROM allowed_simple) AND old_key <> new_name
          AND old_key NOT IN (%s))))""" % ",".join("'%s'" % w for w in S.RESERVED_WORDS)


@register("resolve_class_suggestions", SQL_SUGG + " SELECT old_key, new_name FROM cls")
def q_resolve_class(spark, d):
    return S.resolve_class_suggestions(_suggestions(spark, d), _units(spark, d)).select("old_key", "new_name")


@register("resolve_method_suggestions", SQL_SUGG + " SELECT old_key, new_name FROM meth")
def q_resolve_method(spark, d):
    return S.resolve_method_suggestions(_suggestions(spark, d), _units(spark, d)).select("old_key", "new_name")


@register("first_wins", SQL_SUGG + " SELECT kind, old_key, new_name FROM mapping")
def q_first_wins(spark, d):
    return S.suggestions_to_mapping(_suggestions(spark, d), _units(spark, d)).select("kind", "old_key", "new_name")


def _restricted(spark, d):
    units = _units(spark, d)
    checkpoint_dir(spark)
    keys = cut_lineage(S.allowed_keys(units))   # one pass over the units, reused three times
    m = S.suggestions_to_mapping(_suggestions(spark, d), None, keys)
    return S.restrict_to_allowed(m, keys), units, keys


@register("restrict_to_allowed", SQL_SUGG + " SELECT kind, old_key, new_name FROM restricted")
def q_restrict(spark, d):
    return _restricted(spark, d)[0].select("kind", "old_key", "new_name")


_FILL_SQL = "[" + ",".join("'%s'" % p for p in S.FILL_POOL) + "]"


@register("fallback_fill", SQL_SUGG + r""",
base AS (SELECT kind, old_key, new_name, 'model' AS source FROM restricted WHERE kind = 'class'),
guess AS (SELECT qualified_signature AS old_key,
                 arg_min(CASE WHEN contains(code, '+') THEN 'add' WHEN contains(code, 'get') THEN 'get'
                              WHEN contains(code, 'put') THEN 'put' ELSE 'process' END, unit_order) AS new_name
          FROM uu WHERE method_name <> '' GROUP BY qualified_signature),
firsts AS (SELECT key, (row_number() OVER (ORDER BY first_order) - 1) AS rk FROM allowed_simple
           WHERE key NOT IN (%s) ORDER BY first_order LIMIT 7),
fill AS (SELECT key AS old_key, %s[rk + 1] AS new_name FROM firsts)
SELECT kind, old_key, new_name, source FROM base
UNION ALL SELECT 'method', old_key, new_name, 'fallback' FROM guess
UNION ALL SELECT 'simple', old_key, new_name, 'fallback' FROM fill WHERE old_key <> new_name""" % (
    ",".join("'%s'" % w for w in S.RESERVED_WORDS), _FILL_SQL))
def q_fallback_fill(spark, d):
    restricted, units, keys = _restricted(spark, d)
    only_classes = restricted.filter(F.col("kind") == "class")
    out = S.fallback_fill(only_classes, units, keys)
    return out.select("kind", "old_key", "new_name", "source")


@register("mapping_sizes", SQL_SUGG + " SELECT kind, count(*)::BIGINT AS n_rules FROM restricted GROUP BY kind")
def q_mapping_sizes(spark, d):
    return S.mapping_sizes(_restricted(spark, d)[0])


# ============================================================ ledger

@register("pending_files", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_pending_files(spark, d):
    from legible.sources.files import pending_files
    return pending_files(docs(spark, d, "doc_id", "source"), table(spark, d, "labels", "doc_id"), "doc_id")


# ============================================================ spans

@register("rewrite_occurrences", """
WITH pool AS (%s),
m AS (SELECT map_from_entries(list({'k': token, 'v': new_name})) AS mp FROM pool),
d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+') AS toks FROM documents)
SELECT d.doc_id,
       array_to_string(list_transform(d.toks, lambda x: CASE WHEN regexp_full_match(x, '[a-z]{1,2}[0-9]?')
                                                         THEN coalesce(m.mp[x], x) ELSE x END), '') AS new_text,
       len(list_filter(d.toks, lambda x: regexp_full_match(x, '[a-z]{1,2}[0-9]?') AND m.mp[x] IS NOT NULL))::BIGINT
         AS n_replacements
FROM d CROSS JOIN m""" % SQL_POOL)
def q_rewrite_occurrences(spark, d):
    ds = docs(spark, d, "doc_id", "text")
    mapping = _pool(spark, d).select(F.lit("simple").alias("kind"), F.col("token").alias("old_key"), "new_name")
    return R.rewrite_token_spans(ds, S.SHORT_ID, mapping).select("doc_id", "new_text", "n_replacements")


@register("token_occurrences", """
WITH t AS (SELECT doc_id, i, toks[i] AS tok FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i
             FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+') AS toks FROM documents))),
p AS (SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM t)
SELECT doc_id, tok AS old_key, (stop - length(tok))::BIGINT AS start, stop::BIGINT AS stop
FROM p WHERE regexp_full_match(tok, '[a-z]{1,2}[0-9]?')""")
def q_token_occurrences(spark, d):
    occ = R.token_occurrences(docs(spark, d, "doc_id", "text"), S.SHORT_ID, "simple")
    return occ.select("doc_id", "old_key", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("stop"))


@register("attach_docs", r"""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l:
         CASE WHEN regexp_matches(l, '^[A-Z]') THEN '/** ' || regexp_extract(l, '^[A-Za-z]+', 0) || ' */' || chr(10) || l
              ELSE l END), chr(10)) AS new_text,
       len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[A-Z]')))::BIGINT AS n_docs
FROM documents""")
def q_attach_docs(spark, d):
    ds = docs(spark, d, "doc_id", "text")

    # target = a line starting with a capital ASCII letter; its offset is the running length, found in the row
    def items(lines):
        at = R.starts_of(F.transform(lines, lambda x: F.length(x) + 1))
        both = F.zip_with(lines, at, lambda x, k: F.struct(k.alias("start"), k.alias("end"), F.concat(
            F.lit("/** "), F.regexp_extract(x, "^[A-Za-z]+", 0), F.lit(" */")).alias("block"), x.alias("line")))
        return F.filter(both, lambda z: z["line"].rlike("^[A-Z]"))
    return R.attach_docs_in_row(ds, let(F.split("text", "\n", -1), items)).select("doc_id", "new_text", "n_docs")


# ============================================================ docs

KW_LIST = ["toJson", "hashCode", "parse", "fetch", "init", "close", "run"]


def _doc_frame(spark, d):
    conv = table(spark, d, "conversations", "conv_id", "turn", "text")
    w = F.regexp_extract("text", "[A-Za-z]+", 0)
    cap = F.when(w == "", F.lit("Value")).otherwise(F.concat(F.upper(F.substring(w, 1, 1)),
                                                             F.lower(F.substring(w, 2, 1 << 30))))
    kw = F.element_at(F.array(*[F.lit(k) for k in KW_LIST]), (F.col("conv_id") % len(KW_LIST) + 1).cast("int"))
    t5 = F.col("turn") % 5
    header = (F.when(t5 == 0, F.concat(F.lit("public String get"), cap, F.lit("()")))
               .when(t5 == 1, F.concat(F.lit("public void set"), cap, F.lit("(String v)")))
               .when(t5 == 2, F.concat(F.lit("public boolean is"), cap, F.lit("()")))
               .when(t5 == 3, F.concat(F.lit("void "), kw, cap, F.lit("()")))
               .otherwise(T.first_line("text")))
    return conv.select("conv_id", "turn", "text",
                       F.concat(header, F.lit("\n"), F.col("text")).alias("snippet"),
                       F.when(F.col("conv_id") % 2 == 0, F.lit("en")).otherwise(F.lit("zh")).alias("lang"),
                       F.when(F.col("turn") % 2 == 0, F.lit("concise")).otherwise(F.lit("detailed")).alias("style"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lang_sql(en: str, zh: str) -> str:
    return "CASE WHEN lang = 'zh' THEN %s ELSE %s END" % (_q(zh), _q(en))


_PRETTY = (r"CASE WHEN {x} IS NULL OR {x} = '' THEN 'value' ELSE "
           r"trim(lower(substr({x}, 1, 1) || regexp_replace(substr({x}, 2), '(\p{{Lu}})', ' \1', 'g'))) END")


def _doc_sql() -> str:
    parts = []
    for kind, pat in (("get", GETTER), ("set", SETTER), ("is", ISSER)):
        hit = "regexp_extract(header, %s, 1)" % _q(pat)
        parts.append("WHEN regexp_matches(header, %s) THEN replace(%s, '%%s', %s)" % (
            _q(pat), _lang_sql(ACCESSOR_TEXT["en"][kind], ACCESSOR_TEXT["zh"][kind]), _PRETTY.format(x=hit)))
    kw = []
    for words, en, zh in KEYWORD_RULES:
        cond = " OR ".join("contains(lower(header), %s)" % _q(w) for w in words)
        kw.append("WHEN %s THEN %s" % (cond, _lang_sql(en, zh)))
    kw_expr = "(CASE %s ELSE %s END) || CASE WHEN style = 'detailed' THEN %s ELSE '' END" % (
        " ".join(kw), _lang_sql(*DEFAULT_TEXT), _lang_sql(*DETAILED_SUFFIX))
    return "CASE %s ELSE %s END" % (" ".join(parts), kw_expr)


SQL_DOC_FRAME = r"""
WITH c AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[A-Za-z]+')[1] AS w FROM conversations),
h AS (SELECT conv_id, turn, text,
        CASE turn %% 5
          WHEN 0 THEN 'public String get' || coalesce(upper(substr(w, 1, 1)) || lower(substr(w, 2)), 'Value') || '()'
          WHEN 1 THEN 'public void set' || coalesce(upper(substr(w, 1, 1)) || lower(substr(w, 2)), 'Value') || '(String v)'
          WHEN 2 THEN 'public boolean is' || coalesce(upper(substr(w, 1, 1)) || lower(substr(w, 2)), 'Value') || '()'
          WHEN 3 THEN 'void ' || %s[(conv_id %% 7) + 1] || coalesce(upper(substr(w, 1, 1)) || lower(substr(w, 2)), 'Value') || '()'
          ELSE split_part(text, chr(10), 1) END AS hdr,
        CASE WHEN conv_id %% 2 = 0 THEN 'en' ELSE 'zh' END AS lang,
        CASE WHEN turn %% 2 = 0 THEN 'concise' ELSE 'detailed' END AS style FROM c),
f AS (SELECT conv_id, turn, text, lang, style,
        regexp_replace(split_part(hdr || chr(10) || text, chr(10), 1), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS header
      FROM h),
docs AS (SELECT conv_id, turn, text, lang, style, %s AS doc FROM f)""" % (
    "[" + ",".join(_q(k) for k in KW_LIST) + "]", _doc_sql())


@register("heuristic_docs", SQL_DOC_FRAME + " SELECT conv_id, turn, doc FROM docs")
def q_heuristic_docs(spark, d):
    f = _doc_frame(spark, d)
    return f.select("conv_id", "turn", heuristic_doc(F.col("snippet"), F.col("lang"), F.col("style")).alias("doc"))


def _tags_cols():
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    params = F.transform(F.slice(words, 1, 2), lambda x: F.lower(x))
    t3 = F.col("turn") % 3
    ret = F.when(t3 == 0, F.lit("void")).when(t3 == 1, F.lit("String"))
    thr = F.when(F.col("turn") % 2 == 0, F.array(F.lit("IOException"))).otherwise(F.array().cast("array<string>"))
    lang = F.when(F.col("conv_id") % 2 == 0, F.lit("en")).otherwise(F.lit("zh"))
    return T.render_doc_tags(params, ret, thr, lang)


SQL_TAGS = r"""
WITH t AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(text, '[A-Za-z]+')[1:2], lambda x: lower(x)) AS params,
                  CASE turn % 3 WHEN 0 THEN 'void' WHEN 1 THEN 'String' ELSE NULL END AS ret,
                  CASE WHEN turn % 2 = 0 THEN ['IOException'] ELSE []::VARCHAR[] END AS thr,
                  CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang FROM conversations),
tags AS (SELECT conv_id, turn, text,
  array_to_string(list_transform(params, lambda p: ' * @param ' || p || CASE WHEN lang = 'zh' THEN ' 参数' ELSE ' parameter' END || chr(10)), '') ||
  CASE WHEN ret IS NOT NULL AND ret <> 'void' THEN CASE WHEN lang = 'zh' THEN ' * @return 返回值' ELSE ' * @return return value' END || chr(10) ELSE '' END ||
  array_to_string(list_transform(thr, lambda x: ' * @throws ' || x || CASE WHEN lang = 'zh' THEN ' 可能抛出的异常' ELSE ' possible exception' END || chr(10)), '')
  AS tags FROM t)"""


@register("render_doc_tags", SQL_TAGS + " SELECT conv_id, turn, tags FROM tags")
def q_render_doc_tags(spark, d):
    conv = table(spark, d, "conversations", "conv_id", "turn", "text")
    return conv.select("conv_id", "turn", _tags_cols().alias("tags"))


_JTRIM_SQL = r"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@register("doc_block", SQL_TAGS + r""",
ml AS (SELECT conv_id, turn, tags, CASE WHEN text = '' THEN ['']
                  WHEN regexp_replace(text, '\n+$', '') = '' THEN []::VARCHAR[]
                  ELSE string_split(regexp_replace(text, '\n+$', ''), chr(10)) END AS mlines,
              CASE WHEN tags = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(tags, '\n+$', ''), chr(10)) END AS tlines
       FROM tags)
SELECT conv_id, turn, '/**' || chr(10) ||
  array_to_string(list_transform(mlines, lambda l: CASE WHEN l = '' THEN ' *' ELSE ' * ' || """ +
          _JTRIM_SQL.format(x="l") + r""" END || chr(10)), '') ||
  array_to_string(list_transform(tlines, lambda l: CASE WHEN l = '' THEN ' *' WHEN starts_with(l, ' *') THEN l
                                                     ELSE ' * ' || l END || chr(10)), '') || ' */' AS block
FROM ml""")
def q_doc_block(spark, d):
    conv = table(spark, d, "conversations", "conv_id", "turn", "text")
    return conv.select("conv_id", "turn", T.doc_block(F.col("text"), _tags_cols()).alias("block"))


def _wrapped_doc(text):
    return F.concat(F.lit("```java\n/**\n * "), F.replace(text, F.lit("\n"), F.lit("\n * ")), F.lit("\n */\n```"))


_J = _JTRIM_SQL.format


@register("clean_doc_text", r"""
WITH a AS (SELECT conv_id, turn, %(t0)s AS t FROM (
             SELECT conv_id, turn, '```java' || chr(10) || '/**' || chr(10) || ' * ' ||
                    replace(text, chr(10), chr(10) || ' * ') || chr(10) || ' */' || chr(10) || '```' AS raw
             FROM conversations)),
b AS (SELECT conv_id, turn, t, CASE WHEN strpos(t, chr(10)) > 0 THEN substr(t, strpos(t, chr(10)) + 1) ELSE t END AS body
      FROM a),
c AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '```') THEN %(tb)s ELSE t END AS t FROM (
        SELECT conv_id, turn, t, CASE WHEN strpos(reverse(body), '```') > 0
                                      THEN substr(body, 1, length(body) - strpos(reverse(body), '```') - 2)
                                      ELSE body END AS body FROM b)),
e AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '/**') AND strpos(reverse(t), '/*') > 0
           THEN %(ts)s ELSE t END AS t FROM c),
l AS (SELECT conv_id, turn, %(tj)s AS t FROM e)
SELECT conv_id, turn, %(tf)s AS cleaned FROM l""" % {
    "t0": _J(x="raw"), "tb": _J(x="body"),
    "ts": _J(x="substr(t, 4, length(t) - strpos(reverse(t), '/*') - 1 - 3)"),
    "tj": _J(x="array_to_string(list_transform(string_split_regex(t, '\\r?\\n'), lambda ln: CASE WHEN starts_with("
              + _J(x="ln") + ", '*') THEN " + _J(x="substr(" + _J(x="ln") + ", 2)") + " ELSE " + _J(x="ln")
              + " END || chr(10)), '')"),
    "tf": _J(x="regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+\\n', chr(10), 'g')")})
def q_clean_doc_text(spark, d):
    conv = table(spark, d, "conversations", "conv_id", "turn", "text")
    return conv.select("conv_id", "turn", T.clean_doc_text(_wrapped_doc(F.col("text"))).alias("cleaned"))


@register("align_by_position", SQL_PACK + """,
sizes AS (SELECT conv_id, batch_no, count(*) AS n FROM packed GROUP BY conv_id, batch_no),
outs AS (
  SELECT p.conv_id, p.batch_no, p.pos, 'doc ' || p.conv_id || '/' || p.batch_no || '/' || p.pos AS doc
  FROM packed p JOIN sizes s USING (conv_id, batch_no) WHERE NOT (p.batch_no % 2 = 1 AND p.pos = s.n - 1)
  UNION ALL SELECT conv_id, batch_no, n, 'extra' FROM sizes WHERE batch_no % 2 = 0)
SELECT p.conv_id, p.turn, coalesce(o.doc, '') AS doc
FROM packed p LEFT JOIN outs o ON o.conv_id = p.conv_id AND o.batch_no = p.batch_no AND o.pos = p.pos""")
def q_align_by_position(spark, d):
    conv = table(spark, d, "conversations", "conv_id", "turn", "text")
    packed = pack_by_budget(conv, ["conv_id"], ["turn"], text_col="text", budget=PACK_BUDGET, max_items=PACK_MAX)
    packed = packed.select("conv_id", "turn", "batch_no", "pos").persist()
    sizes = packed.groupBy("conv_id", "batch_no").agg(F.count(F.lit(1)).alias("n"))
    outs = (packed.join(sizes, ["conv_id", "batch_no"])
                  .filter(~((F.col("batch_no") % 2 == 1) & (F.col("pos") == F.col("n") - 1)))
                  .select("conv_id", "batch_no", "pos",
                          F.concat(F.lit("doc "), F.col("conv_id").cast("string"), F.lit("/"),
                                   F.col("batch_no").cast("string"), F.lit("/"), F.col("pos").cast("string")).alias("doc")))
    extra = sizes.filter(F.col("batch_no") % 2 == 0).select("conv_id", "batch_no", F.col("n").cast("bigint").alias("pos"),
                                                             F.lit("extra").alias("doc"))
    aligned = I.align_by_position(packed, outs.unionByName(extra), ["conv_id", "batch_no"])
    return aligned.select("conv_id", "turn", "doc")


from legible.plans import catalog_folders  # noqa: E402,F401


@register("doc_prompts", SQL_DOC_FRAME + r"""
SELECT conv_id, turn,
  CASE WHEN lang = 'zh' THEN %s ELSE %s END || chr(10) || 'Style: ' || style || chr(10) || chr(10) || '```java' || chr(10) ||
  CASE WHEN len(string_split(text, chr(10))) <= 75 THEN text ELSE
    array_to_string(list_transform(string_split(text, chr(10))[1:40], lambda x: x || chr(10)), '') ||
    '// ... (trimmed) ...' || chr(10) ||
    array_to_string(list_transform(string_split(text, chr(10))[-30:], lambda x: x || chr(10)), '') END ||
  chr(10) || '```' || chr(10) AS prompt
FROM docs""" % (_q(I.DOC_RULES["zh"]), _q(I.DOC_RULES["en"])))
def q_doc_prompts(spark, d):
    f = _doc_frame(spark, d)
    return f.select("conv_id", "turn", I.doc_prompt(F.col("text"), F.col("lang"), F.col("style")).alias("prompt"))


@register("heuristic_names", SQL_SUGG + r""",
dtok AS (SELECT tok, count(*)::BIGINT AS cnt FROM (
           SELECT unnest(regexp_split_to_array(decl, '[^A-Za-z0-9_]')) AS tok FROM uu)
         WHERE regexp_full_match(tok, '[a-z]{1,2}[0-9]?') GROUP BY tok),
dtop AS (SELECT tok, (row_number() OVER (ORDER BY cnt DESC, tok ASC) - 1)::BIGINT AS rnk FROM dtok
         ORDER BY cnt DESC, tok ASC LIMIT 32),
dpool AS (SELECT tok, rnk, %s[(rnk %% 16) + 1] || CASE WHEN rnk // 16 = 0 THEN '' ELSE (rnk // 16)::VARCHAR END AS new_name
          FROM dtop)
SELECT 'simple' AS kind, tok AS old_key, new_name FROM dpool WHERE tok <> new_name
UNION ALL
SELECT 'method', qualified_signature, arg_min('get' || class_name, unit_order) FROM uu
WHERE length(method_name) <= 2 AND method_name <> '' AND qualified_signature NOT LIKE '%%(%%,%%' AND
      qualified_signature LIKE '%%()'
GROUP BY qualified_signature""" % ("[" + ",".join("'%s'" % p for p in S.NAME_POOL) + "]"))
def q_heuristic_names(spark, d):
    return S.heuristic_names(_units(spark, d)).select("kind", "old_key", "new_name")
