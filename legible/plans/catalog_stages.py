"""Stage files, paths and the end-to-end pipeline (registered on import)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from legible.functions import text as T
from legible.operators import extract as E
from legible.operators import rewrite as R
from legible.operators import suggest as S
from legible.plans import jobs as J
from legible.plans.catalog import docs, register
from legible.plans.catalog_java import SQL_JAVA_UNITS, java_sources
from legible.plans.catalog_rewrite import _DUCK_PAGE, linked_mapping, linked_sources
from legible.plans.pipeline import pipeline_job
from legible.session import checkpoint_dir, cut_lineage
from legible.sources import files as SF
from legible.sources.tables import table


def _folder(spark, name: str) -> str:
    return "%s/%s-%s" % (checkpoint_dir(spark).rstrip("/"), name, uuid.uuid4().hex)


@register("pipeline_job", """
SELECT stage, n_rows FROM (SELECT count(*)::BIGINT AS n FROM pages) p, LATERAL (VALUES
  ('declarations', 6 * n), ('units', 5 * n), ('applied', n), ('packages', n), ('new_declarations', 6 * n), ('documented', n)) AS s(stage, n_rows)""")
def q_pipeline_job(spark, d):
    """Rows of every finished stage (the mapping's size is a matter of the names)."""
    out = pipeline_job(java_sources(spark, d), _folder(spark, "pipeline"), J.Options(refactor_packages=True))
    return out["state"].filter("stage <> 'mapping'").select("stage", "n_rows")


@register("rename_file_for_type", f"""
WITH page AS ({_DUCK_PAGE})
SELECT s.page_id, replace(s.pkg, '.', '/') || '/' || coalesce(p.cls, s.cls) || '.java' AS new_path
FROM page s LEFT JOIN page p ON p.page_id = s.mate""")
def q_rename_file_for_type(spark, d):
    """Files follow their swapped classes."""
    files = linked_sources(spark, d)
    out = J.apply_job(files, linked_mapping(files), decls=cut_lineage(E.java_declarations(files)))
    return out.select("page_id", "new_path")


@register("rename_file_conflicts", f"""
WITH page AS ({_DUCK_PAGE}), f AS (SELECT *, replace(pkg, '.', '/') AS dir FROM page),
r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY dir || '/' || cls || '.java') AS k FROM f WHERE page_id % 2 = 0)
SELECT f.page_id, f.dir || '/' || CASE WHEN r.k IS NULL THEN f.cls WHEN r.k = 1 THEN 'Shared' ELSE 'Shared' || r.k END || '.java' AS new_path
FROM f LEFT JOIN r USING (page_id)""")
def q_rename_file_conflicts(spark, d):
    """Every second class of a package gets one and the same new name."""
    files = linked_sources(spark, d)
    rules = cut_lineage(files.filter("page_id % 2 = 0").select(
        F.lit("class").alias("kind"), F.concat("pkg", F.lit("."), "cls").alias("old_key"), F.concat("pkg", F.lit(".Shared")).alias("new_name"),
        F.col("page_id").alias("prio")))
    return R.rename_files_for_types(files, cut_lineage(E.java_declarations(files)), rules).select("page_id", "new_path")


@register("mapping_files", """
SELECT kind, old_key, new_name, prio FROM (
  SELECT ['class', 'method', 'field', 'simple'][1 + o_orderkey % 4] AS kind, 'k.' || o_orderkey AS old_key,
         'n"' || chr(10) || o_orderkey AS new_name, o_orderkey::BIGINT AS prio FROM orders)""")
def q_mapping_files(spark, d):
    """The mapping's stage file written and read back in both formats (rules that both hold)."""
    key = F.col("o_orderkey")
    m = table(spark, d, "orders", "o_orderkey").select(
        F.get(F.array(*[F.lit(k) for k in ("class", "method", "field", "simple")]), (key % 4).cast("int")).alias("kind"),
        F.concat(F.lit("k."), key.cast("string")).alias("old_key"), F.concat(F.lit('n"\n'), key.cast("string")).alias("new_name"),
        key.cast("bigint").alias("prio"))
    a, b = _folder(spark, "mapping"), _folder(spark, "mapping")
    SF.write_mapping_table(m, a)
    SF.write_mapping_table(m, b, "json")
    cols = ["kind", "old_key", "new_name", "prio"]
    return SF.read_mapping_table(spark, a).join(SF.read_mapping_table(spark, b, "json"), cols).select(*cols)


@register("snippet_files", SQL_JAVA_UNITS)
def q_snippet_files(spark, d):
    """Units written as the snippet stage file and read back."""
    _, units, _ = J.analyze_job(java_sources(spark, d))
    path = _folder(spark, "snippets")
    SF.write_snippets(units, path)
    back = SF.read_snippets(spark, path)
    return back.select("file", "unit_kind", "class_fqn", "qualified_signature", "decl", F.size("param_types").cast("bigint").alias("n_params"))


@register("relative_path", r"""
SELECT page_id, regexp_replace(url, '^[A-Za-z]+://[^/]*/?', '') AS rel_path,
       lower(regexp_extract(regexp_extract(regexp_replace(url, '^[A-Za-z]+://[^/]*/?', ''), '[^/]*$', 0), '\.[^.]*$', 0)) AS ext
FROM pages WHERE url IS NOT NULL""")
def q_relative_path(spark, d):
    """Every url's path below its host, as a file below a root."""
    p = table(spark, d, "pages", "page_id", "url").filter("url is not null")
    rel = T.relative_path("url", "any://host/")
    return p.select("page_id", rel.alias("rel_path"), T.ext_of(rel).alias("ext"))


GLOBS = ["**/en/**", "*/?[0-9]*", "{com,de}/**/b*"]


@register("exclude_globs", r"""
WITH f AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1), '.')), '/')
                  || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS rel_path FROM pages)
SELECT page_id, rel_path FROM f
WHERE NOT (contains(rel_path, '/en/') OR regexp_full_match(rel_path, '[^/]*/[^/][0-9][^/]*') OR regexp_full_match(rel_path, '(com|de)/.*/b[^/]*'))""")
def q_exclude_globs(spark, d):
    """Paths that no glob names, through the job's option."""
    host = F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]+)", 1)
    rel = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "/"), F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    f = table(spark, d, "pages", "page_id", "url").select("page_id", rel.alias("rel_path"))
    return J.included(f, J.Options(exclude_globs=GLOBS))


@register("names_of_paths", r"""
WITH f AS (SELECT page_id, 'com/' || replace(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1), '.', '/') || '/P' || page_id || '.java' AS path FROM pages),
q AS (SELECT *, replace(substr(path, 1, length(path) - 5), '/', '.') AS fqn FROM f)
SELECT page_id, fqn, 'P' || page_id AS simple_name, substr(fqn, 1, length(fqn) - length('P' || page_id) - 1) AS parent_name,
       'pkg.x' || page_id AS pkg FROM q""")
def q_names_of_paths(spark, d):
    """Qualified name of a path, its parts, and the package line of a text."""
    key = F.col("page_id").cast("string")
    host = F.replace(F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]+)", 1), F.lit("."), F.lit("/"))
    f = table(spark, d, "pages", "page_id", "url").select("page_id", F.concat(F.lit("com/"), host, F.lit("/P"), key, F.lit(".java")).alias("path"),
                                                          F.concat(F.lit("// package no;\n  package  pkg.x"), key, F.lit(" ;\nclass A {}")).alias("text"))
    fqn = T.fqn_from_path("path")
    return f.select("page_id", fqn.alias("fqn"), T.simple_name(fqn).alias("simple_name"), T.parent_name(fqn).alias("parent_name"),
                    E.package_of("text").alias("pkg"))


@register("valid_suggestions", """
WITH s AS (SELECT doc_id, ['class', 'method', 'field', 'var', 'note', NULL][1 + doc_id % 6] AS kind,
                  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS old, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE 'n' || doc_id END AS new FROM documents)
SELECT doc_id, kind IS NOT NULL AND kind <> 'note' AND old IS NOT NULL AND trim(new) <> '' AS valid FROM s""")
def q_valid_suggestions(spark, d):
    """Both sides of the split: nothing is lost."""
    key = F.col("doc_id")
    s = docs(spark, d, "doc_id", "source").select(
        "doc_id", F.get(F.array(*[F.lit(k) for k in ("class", "method", "field", "var", "note", None)]), (key % 6).cast("int")).alias("kind"),
        F.when(key % 7 != 0, F.col("source")).alias("old"), F.when(key % 5 == 0, "  ").otherwise(F.concat(F.lit("n"), key.cast("string"))).alias("new"))
    good, bad = S.valid_suggestions(s)
    return good.select("doc_id", F.lit(True).alias("valid")).unionByName(bad.select("doc_id", F.lit(False).alias("valid")))


@register("dry_run_stats", "SELECT count(*)::BIGINT AS n_files, count(*) FILTER (WHERE contains(text, 'a'))::BIGINT AS n_changed, "
          "sum(length(text) - length(replace(text, 'a', '')))::BIGINT AS n_replacements FROM documents")
def q_dry_run_stats(spark, d):
    f = docs(spark, d, "doc_id", "text").withColumn("new_text", F.replace("text", F.lit("a"), F.lit("b")))
    return SF.dry_run_stats(f.withColumn("n_replacements", F.length("text") - F.length(F.replace("text", F.lit("a"), F.lit("")))))
