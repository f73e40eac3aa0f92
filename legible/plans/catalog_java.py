"""Java-source queries: sources are generated per page from the ``pages`` table, so the work grows
with it.  The declaration scanner is a brace-matching parser SQL cannot express, so the oracles
rebuild the expected results from the generator's known shape (units, renamed and annotated texts).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from legible.plans import jobs as J
from legible.plans.catalog import SQL_REWRITE_BASE, register
from legible.plans.catalog_folders import SQL_FILES, page_files


def java_sources(spark, d):
    """One Java file per page: a class named after the title, a constructor, two accessors, a
    short-named static helper, a nested interface; every third class already documented."""
    f = page_files(spark, d)
    title_words = F.regexp_extract_all(F.col("name"), F.lit("[A-Za-z]+"), 0)

    def cap(i):
        w = F.get(title_words, i)
        return F.coalesce(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))), F.lit("Value"))
    # "h" + first letter of the first word: a short identifier that is never a Java keyword
    short = F.concat(F.lit("h"), F.coalesce(F.lower(F.substring(F.get(title_words, 0), 1, 1)), F.lit("x")))
    fld = F.concat(F.coalesce(F.lower(F.substring(F.get(title_words, 1), 1, 1)), F.lit("v")), F.lit("0"))
    cls = F.concat(F.col("name"), F.lit("_"), F.col("page_id").cast("string"))   # unique per page: rel_path is the key
    nl = F.lit("\n")
    text = F.concat(
        F.lit("package "), F.regexp_replace(F.regexp_replace("folder", "[^A-Za-z0-9/]", ""), "/", "."), F.lit(";"), nl, nl,
        F.lit("import java.util.List;"), nl, nl,
        F.when(F.col("page_id") % 3 == 0, F.lit("/** Existing doc. */\n")).otherwise(F.lit("")),
        F.lit("public class "), cls, F.lit(" {"), nl,
        F.lit("    private String "), fld, F.lit(";"), nl,
        F.lit("    public "), cls, F.lit("(String "), fld, F.lit(") { this."), fld, F.lit(" = "), fld, F.lit("; }"), nl,
        F.lit("    public String get"), cap(0), F.lit("() { return \""), cap(0), F.lit("\"; }"), nl,
        F.lit("    public void set"), cap(1), F.lit("(String v) { if (v != null) { this."), fld, F.lit(" = v; } }"), nl,
        F.lit("    static int "), short, F.lit("(String s) { int x = 0; for (int i = 0; i < s.length(); i++) "
                                       "{ x = x + s.charAt(i); } return x; }"), nl,
        F.lit("    interface In"), F.col("page_id").cast("string"), F.lit(" { }"), nl,
        F.lit("}"), nl)
    rel = F.concat(F.col("folder"), F.lit("/"), cls, F.lit(".java"))
    return f.select("page_id", rel.alias("rel_path"), text.alias("text"))


SQL_JAVA_UNITS = SQL_FILES + r""",
j AS (SELECT page_id, folder || '/' || name || '_' || page_id || '.java' AS file,
             regexp_replace(regexp_replace(folder, '[^A-Za-z0-9/]', '', 'g'), '/', '.', 'g') AS pkg,
             name || '_' || page_id AS cls,
             regexp_extract_all(name, '[A-Za-z]+') AS tw FROM files),
k AS (SELECT *, CASE WHEN pkg = '' THEN cls ELSE pkg || '.' || cls END AS fqn,
             coalesce(upper(substr(tw[1], 1, 1)) || lower(substr(tw[1], 2)), 'Value') AS c0,
             coalesce(upper(substr(tw[2], 1, 1)) || lower(substr(tw[2], 2)), 'Value') AS c1,
             'h' || coalesce(lower(substr(tw[1], 1, 1)), 'x') AS short FROM j)
SELECT file, 'ctor' AS unit_kind, fqn AS class_fqn, fqn || '.' || cls || '(String)' AS qualified_signature,
       cls || '(String)' AS decl, 1::BIGINT AS n_params FROM k
UNION ALL SELECT file, 'method', fqn, fqn || '.get' || c0 || '()', 'String get' || c0 || '()', 0 FROM k
UNION ALL SELECT file, 'method', fqn, fqn || '.set' || c1 || '(String)', 'void set' || c1 || '(String)', 1 FROM k
UNION ALL SELECT file, 'method', fqn, fqn || '.' || short || '(String)', 'int ' || short || '(String)', 1 FROM k
UNION ALL SELECT file, 'class', fqn || '.In' || page_id, fqn || '.In' || page_id, 'interface In' || page_id, 0 FROM k"""


@register("analyze_java_units", SQL_JAVA_UNITS)
def q_analyze_java_units(spark, d):
    files = java_sources(spark, d)
    _, units, _ = J.analyze_job(files)
    return units.select("file", "unit_kind", "class_fqn", "qualified_signature", "decl",
                        F.size("param_types").cast("bigint").alias("n_params"))


def _rename_sql() -> str:
    from legible.operators.suggest import NAME_POOL
    pool = "[" + ",".join("'%s'" % x for x in NAME_POOL) + "]"
    return SQL_FILES + r""",
j AS (SELECT page_id, folder, folder || '/' || name || '_' || page_id || '.java' AS file,
             regexp_replace(regexp_replace(folder, '[^A-Za-z0-9/]', '', 'g'), '/', '.', 'g') AS pkgline,
             name || '_' || page_id AS cls, regexp_extract_all(name, '[A-Za-z]+') AS tw FROM files),
k AS (SELECT *, coalesce(upper(substr(tw[1], 1, 1)) || lower(substr(tw[1], 2)), 'Value') AS c0,
             coalesce(upper(substr(tw[2], 1, 1)) || lower(substr(tw[2], 2)), 'Value') AS c1,
             'h' || coalesce(lower(substr(tw[1], 1, 1)), 'x') AS short,
             coalesce(lower(substr(tw[2], 1, 1)), 'v') || '0' AS fld FROM j),
src AS (SELECT *, 'package ' || pkgline || ';' || chr(10) || chr(10) || 'import java.util.List;' || chr(10) || chr(10) ||
          CASE WHEN page_id %% 3 = 0 THEN '/** Existing doc. */' || chr(10) ELSE '' END ||
          'public class ' || cls || ' {' || chr(10) || '    private String ' || fld || ';' || chr(10) ||
          '    public ' || cls || '(String ' || fld || ') { this.' || fld || ' = ' || fld || '; }' || chr(10) ||
          '    public String ' || '{G}' || '() { return "' || c0 || '"; }' || chr(10) ||
          '    public void ' || '{S}' || '(String v) { if (v != null) { this.' || fld || ' = v; } }' || chr(10) ||
          '    static int ' || '{H}' || '(String s) { int x = 0; for (int i = 0; i < s.length(); i++) '
              || '{ x = x + s.charAt(i); } return x; }' || chr(10) ||
          '    interface In' || page_id || ' { }' || chr(10) || '}' || chr(10) AS tmpl,
          -- the file's path-derived owner equals the declared class only when the folder is clean
          replace(folder, '/', '.') || '.' || cls = CASE WHEN pkgline = '' THEN cls ELSE pkgline || '.' || cls END AS owned,
          'String get' || c0 || '()' || chr(10) || '{ return "' || c0 || '"; }' AS gcode,
          'void set' || c1 || '(String)' || chr(10) || '{ if (v != null) { this.' || fld || ' = v; } }' AS scode FROM k),
hcnt AS (SELECT short AS tok, count(*) AS c FROM k GROUP BY short),
htop AS (SELECT tok, (row_number() OVER (ORDER BY c DESC, tok ASC) - 1)::BIGINT AS rnk FROM hcnt
         ORDER BY c DESC, tok ASC LIMIT 32),
hpool AS (SELECT tok, %(pool)s[(rnk %% 16) + 1] || CASE WHEN rnk // 16 = 0 THEN '' ELSE (rnk // 16)::VARCHAR END AS nn
          FROM htop),
ex AS (SELECT s.*, p.nn,
         %(guess_g)s AS gguess, %(guess_s)s AS sguess FROM src s LEFT JOIN hpool p ON p.tok = s.short)
SELECT file AS rel_path,
  replace(replace(replace(tmpl, '{G}', CASE WHEN owned THEN gguess ELSE 'get' || c0 END),
                  '{S}', CASE WHEN owned THEN sguess ELSE 'set' || c1 END),
          '{H}', CASE WHEN owned THEN 'add' WHEN nn IS NOT NULL AND nn <> short THEN nn ELSE short END) AS new_text,
  (CASE WHEN owned THEN 3 WHEN nn IS NOT NULL AND nn <> short THEN 1 ELSE 0 END)::BIGINT AS n_replacements
FROM ex""" % {"pool": pool, **{"guess_" + x: f"CASE WHEN contains({x}code, '+') THEN 'add' WHEN contains({x}code, 'get') THEN 'get' "
                                  f"WHEN contains({x}code, 'put') THEN 'put' ELSE 'process' END" for x in "gs"}}


@register("java_rename_job", _rename_sql())
def q_java_rename_job(spark, d):
    files = java_sources(spark, d)
    _, units, _ = J.analyze_job(files)
    mapping = J.suggest_job(units)
    return J.apply_job(files, mapping).select("rel_path", "new_text", "n_replacements")


#: Doc calls of twelve targets in file order; what the provider makes of a call depends on the length of its first header.
SQL_DOC_CALLS = """
tg AS (SELECT hd.*, k.file FROM hd JOIN k USING (page_id) WHERE NOT (ord = 0 AND page_id % 3 = 0)),
rn AS (SELECT *, row_number() OVER (ORDER BY file, ord) - 1 AS rn FROM tg),
sl AS (SELECT *, rn % 12 AS pos, count(*) OVER (PARTITION BY rn // 12) AS n, first_value(header) OVER (PARTITION BY rn // 12 ORDER BY rn) AS h0 FROM rn),
md AS (SELECT page_id, ord, CASE length(h0) % 4 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN pos < n - 1 THEN 'Says ' || header END
                                 WHEN 2 THEN 'Says ' || header ELSE CASE WHEN pos <> 1 THEN 'Says ' || header END END AS said FROM sl),
"""


def _annotate_sql(model: bool = False) -> str:
    from legible.plans.catalog_mapping import _doc_sql
    nl = "chr(10)"

    def ind(b, pad):
        return "(replace(%s, chr(10), chr(10) || '%s') || chr(10) || '%s')" % (b, pad, pad)
    return SQL_FILES + r""",
j AS (SELECT page_id, folder || '/' || name || '_' || page_id || '.java' AS file,
             regexp_replace(regexp_replace(folder, '[^A-Za-z0-9/]', '', 'g'), '/', '.', 'g') AS pkgline,
             name || '_' || page_id AS cls,
             regexp_extract_all(name, '[A-Za-z]+') AS tw FROM files),
k AS (SELECT *, coalesce(upper(substr(tw[1], 1, 1)) || lower(substr(tw[1], 2)), 'Value') AS c0,
             coalesce(upper(substr(tw[2], 1, 1)) || lower(substr(tw[2], 2)), 'Value') AS c1,
             'h' || coalesce(lower(substr(tw[1], 1, 1)), 'x') AS short,
             coalesce(lower(substr(tw[2], 1, 1)), 'v') || '0' AS fld FROM j),
hd AS (SELECT page_id, 0 AS ord, cls AS header, '' AS tags FROM k
       UNION ALL SELECT page_id, 1, 'public ' || cls || '(String ' || fld || ')', ' * @param ' || fld || ' parameter' || chr(10) FROM k
       UNION ALL SELECT page_id, 2, 'public String get' || c0 || '()', ' * @return return value' || chr(10) FROM k
       UNION ALL SELECT page_id, 3, 'public void set' || c1 || '(String v)', ' * @param v parameter' || chr(10) FROM k
       UNION ALL SELECT page_id, 4, 'static int ' || short || '(String s)',
                        ' * @param s parameter' || chr(10) || ' * @return return value' || chr(10) FROM k
       UNION ALL SELECT page_id, 5, 'In' || page_id, '' FROM k),
%(calls)s
dd AS (SELECT page_id, ord, tags, %(said)s AS doc FROM (SELECT *, 'en' AS lang, 'concise' AS style FROM hd) x %(join)s),
bb AS (SELECT page_id, map_from_entries(list({'k': ord, 'v': '/**' || chr(10) || ' * ' || doc || chr(10) || tags || ' */'})) AS b
       FROM dd GROUP BY page_id)
SELECT k.file AS rel_path,
  'package ' || pkgline || ';' || %(nl)s || %(nl)s || 'import java.util.List;' || %(nl)s || %(nl)s ||
  CASE WHEN k.page_id %% 3 = 0 THEN '/** Existing doc. */' || %(nl)s ELSE %(b0)s END ||
  'public class ' || cls || ' {' || %(nl)s ||
  '    private String ' || fld || ';' || %(nl)s ||
  '    ' || %(b1)s || 'public ' || cls || '(String ' || fld || ') { this.' || fld || ' = ' || fld || '; }' || %(nl)s ||
  '    ' || %(b2)s || 'public String get' || c0 || '() { return "' || c0 || '"; }' || %(nl)s ||
  '    ' || %(b3)s || 'public void set' || c1 || '(String v) { if (v != null) { this.' || fld || ' = v; } }' || %(nl)s ||
  '    ' || %(b4)s || 'static int ' || short || '(String s) { int x = 0; for (int i = 0; i < s.length(); i++) '
      || '{ x = x + s.charAt(i); } return x; }' || %(nl)s ||
  '    ' || %(b5)s || 'interface In' || k.page_id || ' { }' || %(nl)s || '}' || %(nl)s AS new_text,
  (CASE WHEN k.page_id %% 3 = 0 THEN 5 ELSE 6 END)::BIGINT AS n_docs %(n_model)s
FROM k JOIN bb USING (page_id)""" % {"calls": SQL_DOC_CALLS if model else "", "join": "LEFT JOIN md USING (page_id, ord)" if model else "",
                                     "said": "coalesce(md.said, %s)" % _doc_sql() if model else _doc_sql(),
                                     "n_model": ", (SELECT count(said) FROM md WHERE md.page_id = k.page_id)::BIGINT AS n_model" if model else "", "nl": nl, "b0": ind("bb.b[0]", ""),
                                      **{"b%d" % i: ind("bb.b[%d]" % i, "    ") for i in range(1, 6)}}


@register("annotate_java", _annotate_sql())
def q_annotate_java(spark, d):
    files = java_sources(spark, d)
    decls, _, _ = J.analyze_job(files)
    return J.annotate_job(files, decls).select("rel_path", "new_text", "n_docs")


@register("incremental_rewrite", SQL_REWRITE_BASE + " SELECT doc_id, new_text, n_replacements FROM rw")
def q_incremental_rewrite(spark, d):
    """The documents' files as a stream, rewritten with the heuristic pool mapping; the result is
    read back from the idempotent sink (rows-only check; equals ``rewrite_tokens``)."""
    from legible.plans.catalog import _pool
    from legible.streaming import incremental as INC
    stream = INC.stream_table(spark, d, "documents").select("doc_id", "text")
    mapping = _pool(spark, d).select(F.col("token").alias("old_key"), "new_name")
    sink, ckpt = INC.run_dirs(spark, "documents")
    INC.incremental_rewrite(stream, mapping, sink, ckpt, key="doc_id")
    return spark.read.parquet(sink).select("doc_id", "new_text", "n_replacements")
