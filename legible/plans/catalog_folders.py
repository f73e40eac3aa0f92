"""Folder-refactor queries over ``pages`` (registered on import).

Each page is a source file: its folder is the reversed host (``com/example/blog``) plus the URL
path segments before the last one; its class-like base name is made of the first four ASCII words
of the page title.  The file text is a small Java header (package line, imports of sibling
language packages), so import rewriting has real work to do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from legible.functions import text as T
from legible.operators import folders as FO
from legible.operators import rewrite as R
from legible.plans.catalog import register
from legible.session import checkpoint_dir, cut_lineage
from legible.sources.tables import table

IMPORT_LANGS = ["en", "fr", "de"]


def page_files(spark, d):
    p = table(spark, d, "pages", "page_id", "url", "html")
    host = F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]+)", 1)
    path = F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    host_folder = F.array_join(F.reverse(F.split(host, "\\.")), "/")
    dirs = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    folder = F.when(F.size(dirs) > 0, F.concat(host_folder, F.lit("/"), F.array_join(dirs, "/"))).otherwise(host_folder)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    words = F.array_join(F.slice(F.regexp_extract_all(title, F.lit("[A-Za-z]+"), 0), 1, 4), "_")
    name = F.when(words == "", F.concat(F.lit("Page"), F.col("page_id").cast("string"))).otherwise(words)
    f = p.select("page_id", folder.alias("folder"), host_folder.alias("host_folder"), name.alias("name"))
    host_pkg = T.normalize_package("host_folder")
    imports = F.concat(*[F.concat(F.lit("import "), host_pkg, F.lit(".%s.Page;\n" % lang)) for lang in IMPORT_LANGS])
    text = F.concat(F.lit("package "), T.normalize_package("folder"), F.lit(";\n"), imports,
                    F.lit("import java.util.List;\n\nclass "), F.col("name"), F.lit(" {}\n"))
    return f.select("page_id", "folder", "name", F.concat("name", F.lit(".java")).alias("file_name"), text.alias("text"))


def _sql_pkg(x: str) -> str:
    return ("array_to_string(list_transform(string_split(regexp_replace(replace(%s, '/', '.'), '\\.+$', ''), '.'), "
            "lambda s: lower(regexp_replace(s, '[^a-zA-Z0-9]', '', 'g'))), '.')" % x)


SQL_FILES = r"""
WITH RECURSIVE p0 AS (
  SELECT page_id, html, regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
p1 AS (SELECT page_id, html, array_to_string(list_reverse(string_split(host, '.')), '/') AS host_folder,
              segs[1:greatest(len(segs) - 1, 0)] AS dirs,
              array_to_string(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '[A-Za-z]+')[1:4], '_') AS words
       FROM p0),
files AS (SELECT page_id, host_folder,
                 CASE WHEN len(dirs) > 0 THEN host_folder || '/' || array_to_string(dirs, '/') ELSE host_folder END AS folder,
                 CASE WHEN words = '' THEN 'Page' || page_id ELSE words END AS name FROM p1),
ftext AS (SELECT page_id, folder, name, name || '.java' AS file_name,
                 'package ' || %(pkg_folder)s || ';' || chr(10) || %(imports)s ||
                 'import java.util.List;' || chr(10) || chr(10) || 'class ' || name || ' {}' || chr(10) AS text
          FROM files),
wf AS (SELECT DISTINCT folder FROM files),
leaves AS (SELECT folder FROM wf WHERE folder NOT IN (SELECT regexp_replace(folder, '/?[^/]*$', '') FROM wf)),
cands0 AS (SELECT folder, regexp_replace(folder, '/?[^/]*$', '') AS parent, %(pkg_folder)s AS pkg,
                  regexp_extract(folder, '[^/]*$', 0) AS leaf FROM leaves),
cands AS (SELECT * FROM cands0
          WHERE NOT regexp_matches(pkg, '^(androidx?|com\.google|org|kotlinx?|java|javax|sun)\b')
            AND regexp_full_match(lower(leaf), '([a-z]{1,2}[0-9]*|[a-z][0-9]+|ui[0-9]+|controls[0-9]+)')
          ),
names AS (SELECT folder, name FROM files WHERE folder IN (SELECT folder FROM cands)),
prompt_names AS (SELECT folder, name FROM (
            SELECT f.folder, f.name, row_number() OVER (PARTITION BY f.folder ORDER BY f.name) AS rn
            FROM files f WHERE f.folder IN (SELECT folder FROM cands)) WHERE rn <= 40),
toks AS (SELECT folder, tok FROM (SELECT folder, unnest(regexp_split_to_array(lower(name), '[^A-Za-z0-9]+')) AS tok FROM names)
         WHERE length(tok) >= 3),
tcnt AS (SELECT folder, tok, count(*)::BIGINT AS cnt FROM toks GROUP BY folder, tok),
top AS (SELECT folder, arg_min(tok, (-cnt, tok)) AS token, max(cnt)::BIGINT AS cnt FROM tcnt GROUP BY folder),
seg AS (SELECT c.folder, c.parent, substr(lower(CASE WHEN regexp_replace(coalesce(t.token, 'module'), '[^A-Za-z0-9]+', '', 'g') = ''
                                                THEN 'pkg' ELSE regexp_replace(coalesce(t.token, 'module'), '[^A-Za-z0-9]+', '', 'g') END), 1, 24) AS segment
        FROM cands c LEFT JOIN top t USING (folder)),
anc AS (SELECT DISTINCT array_to_string(s[1:n], '/') AS folder FROM (
          SELECT s, unnest(generate_series(1, len(s))) AS n FROM (SELECT string_split(folder, '/') AS s FROM wf))),
sib AS (SELECT regexp_replace(folder, '/?[^/]*$', '') AS parent, list(regexp_extract(folder, '[^/]*$', 0)) AS names
        FROM anc GROUP BY 1),
kmax AS (SELECT (SELECT count(*) FROM seg) + (SELECT max(len(names)) FROM sib) + 2 AS k),
ordered AS (SELECT s.*, row_number() OVER (ORDER BY s.folder) AS idx, coalesce(b.names, []) AS sibs
            FROM seg s LEFT JOIN sib b USING (parent)),
greedy(idx, taken, folder, parent, target) AS (
  SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR
  UNION ALL
  SELECT o.idx, list_append(g.taken, o.parent || '/' || %(pick)s), o.folder, o.parent, %(pick)s
  FROM greedy g JOIN ordered o ON o.idx = g.idx + 1),
plan AS (SELECT folder, parent, target,
                CASE WHEN parent = '' THEN target ELSE parent || '/' || target END AS new_folder
         FROM greedy WHERE idx > 0),
pkgmap AS (SELECT %(pkg_old)s AS old_pkg, %(pkg_new)s AS new_pkg, folder AS prio FROM plan
           WHERE %(pkg_old)s <> %(pkg_new)s)""" % {
    "pkg_folder": _sql_pkg("folder"),
    "imports": " || ".join("'import ' || %s || '.%s.Page;' || chr(10)" % (_sql_pkg("host_folder"), lang)
                           for lang in IMPORT_LANGS),
    "pick": ("list_filter([o.segment] || list_transform(generate_series(2, (SELECT k FROM kmax)), "
             "lambda n: o.segment || n::VARCHAR), lambda nm: NOT list_contains(o.sibs, nm) "
             "AND NOT list_contains(g.taken, o.parent || '/' || nm))[1]"),
    "pkg_old": _sql_pkg("folder"), "pkg_new": _sql_pkg("new_folder")}


def _files(spark, d):
    return page_files(spark, d)


def _cands(spark, d):
    return FO.suspicious_folders(_files(spark, d))


def _plan(spark, d):
    checkpoint_dir(spark)
    files = cut_lineage(_files(spark, d))   # the file table feeds five branches: materialise once
    cands = FO.suspicious_folders(files)
    seg = FO.heuristic_segment(cands, files)
    return FO.resolve_name_conflicts(seg, FO.existing_folders(files)), files


@register("leaf_folders", SQL_FILES + " SELECT folder FROM leaves")
def q_leaf_folders(spark, d):
    return FO.leaf_folders(_files(spark, d))


@register("suspicious_folders", SQL_FILES + " SELECT folder, parent, pkg, leaf FROM cands")
def q_suspicious_folders(spark, d):
    return _cands(spark, d).select("folder", "parent", "pkg", "leaf")


@register("limit_candidates", SQL_FILES + " SELECT folder, parent, pkg, leaf FROM cands ORDER BY folder LIMIT 1000")
def q_limit_candidates(spark, d):
    return FO.limit_candidates(_cands(spark, d)).select("folder", "parent", "pkg", "leaf")


@register("top_token_per_group", SQL_FILES + " SELECT folder, token, cnt FROM top")
def q_top_token_per_group(spark, d):
    files = _files(spark, d)
    return FO.top_token_per_group(files.join(_cands(spark, d).select("folder"), "folder", "left_semi").select("folder", "name"))


@register("heuristic_segment", SQL_FILES + " SELECT folder, segment FROM seg")
def q_heuristic_segment(spark, d):
    files = _files(spark, d)
    return FO.heuristic_segment(FO.suspicious_folders(files), files).select("folder", "segment")


@register("resolve_name_conflicts", SQL_FILES + " SELECT folder, new_folder FROM plan")
def q_resolve_name_conflicts(spark, d):
    return _plan(spark, d)[0].select("folder", "new_folder")


@register("move_paths", SQL_FILES + """
SELECT f.page_id, coalesce(p.new_folder, f.folder) || '/' || f.file_name AS new_path
FROM ftext f LEFT JOIN plan p USING (folder)""")
def q_move_paths(spark, d):
    plan, files = _plan(spark, d)
    return FO.move_paths(files, plan).select("page_id", "new_path")


SQL_IMPORTS = SQL_FILES + r""",
lines AS (SELECT page_id, i - 1 AS ln, l[i] AS line FROM (
            SELECT page_id, l, unnest(generate_series(1, len(l))) AS i
            FROM (SELECT page_id, string_split(text, chr(10)) AS l FROM ftext))),
imp AS (SELECT page_id, ln, line, regexp_extract(line, '^\s*import\s+(?:static\s+)?([A-Za-z_$][\w$]*(?:\.[\w$*]+)*)', 1) AS name,
               regexp_extract(line, '^\s*import\s+(static\s+)?', 0) AS pre,
               regexp_extract(line, '^\s*import\s+(static\s+)?', 1) AS stat FROM lines),
hits AS (SELECT i.page_id, i.ln, arg_min((i.line, i.pre, i.stat, m.old_pkg, m.new_pkg), m.prio) AS b
         FROM imp i JOIN pkgmap m ON starts_with(i.name, m.old_pkg || '.') AND i.name <> '' GROUP BY i.page_id, i.ln),
chg AS (SELECT page_id, ln,
          CASE WHEN starts_with(substr(b[1], length(b[2]) + 1), b[4] || '.')
               THEN 'import ' || b[3] || b[5] || '.' || substr(b[1], length(b[2]) + length(b[4]) + 2)
               ELSE b[1] END AS new_line FROM hits),
rewritten AS (SELECT f.page_id, f.folder, f.file_name, f.text,
                array_to_string(list_transform(string_split(f.text, chr(10)), lambda x, i:
                   coalesce(c.m[i - 1], x)), chr(10)) AS new_text, coalesce(c.n, 0)::BIGINT AS n_import_changes
              FROM ftext f LEFT JOIN (SELECT page_id, map_from_entries(list({'k': ln, 'v': new_line})) AS m, count(*) AS n
                                      FROM chg GROUP BY page_id) c USING (page_id))"""


def _import_rewrite(spark, d):
    plan, files = _plan(spark, d)
    return R.rewrite_import_prefix(files, FO.package_map(plan), "page_id"), plan


@register("rewrite_import_prefix", SQL_IMPORTS + " SELECT page_id, new_text, n_import_changes FROM rewritten")
def q_rewrite_import_prefix(spark, d):
    return _import_rewrite(spark, d)[0].select("page_id", "new_text", "n_import_changes")


@register("full_refactor_paths", SQL_IMPORTS + r"""
SELECT r.page_id, coalesce(p.new_folder, r.folder) || '/' || r.file_name AS new_path,
       CASE WHEN p.new_folder IS NULL THEN r.new_text
            ELSE regexp_replace(r.new_text, '^\s*package\s+[^;]+;', 'package ' || %s || ';') END AS new_text
FROM rewritten r LEFT JOIN plan p USING (folder)""" % _sql_pkg("p.new_folder"))
def q_full_refactor_paths(spark, d):
    from legible.plans.jobs import package_refactor_job
    return package_refactor_job(_files(spark, d))[0].select("page_id", "new_path", "new_text")


from legible.plans import catalog_java, catalog_providers, catalog_rewrite, catalog_stages, catalog_units  # noqa: E402,F401  (registers their queries)


# ============================================================ folder prompts (I4) and model-or-heuristic names

def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


from legible.operators import infer as I  # noqa: E402


@register("folder_prompts", SQL_FILES + """,
names_agg AS (SELECT folder, string_agg(name, ', ' ORDER BY name) AS nm FROM prompt_names GROUP BY folder),
fp AS (SELECT ((row_number() OVER (ORDER BY c.folder) - 1) // 100)::BIGINT AS call_no, c.folder,
              '- key: ' || c.folder || ' | package: ' || c.pkg || ' | classes: ' || coalesce(n.nm, '') AS l
       FROM cands c LEFT JOIN names_agg n USING (folder))
SELECT call_no, count(*)::BIGINT AS n_folders,
       %s || chr(10) || chr(10) || string_agg(l, chr(10) ORDER BY folder) AS prompt
FROM fp GROUP BY call_no""" % _sql_lit(I.FOLDER_RULES))
def q_folder_prompts(spark, d):
    files = _files(spark, d)
    cands = FO.suspicious_folders(files)
    names = FO.class_names_per_folder(files.join(cands.select("folder"), "folder", "left_semi"))
    return I.folder_prompts(cands, names)


def _folder_replies(cands):
    body = F.when(F.length("leaf") == 2,
                  F.concat(F.lit('{"'), F.col("folder"), F.lit('": {"newSegment": "'), F.upper("leaf"),
                           F.lit('-Seg"}}'))).otherwise(F.lit("not json"))
    return cands.select("folder", body.alias("reply"))


@register("lookup_or_default", SQL_FILES + r""",
replies AS (SELECT folder, CASE WHEN length(leaf) = 2
                 THEN '{"' || folder || '": {"newSegment": "' || upper(leaf) || '-Seg"}}' ELSE 'not json' END AS reply
            FROM cands),
model AS (SELECT folder, json_extract_string(reply, '$."' || folder || '".newSegment') AS m FROM replies
          WHERE json_valid(reply))
SELECT s.folder,
       CASE WHEN m.m IS NOT NULL THEN substr(lower(CASE WHEN regexp_replace(m.m, '[^A-Za-z0-9]+', '', 'g') = '' THEN 'pkg'
                                                   ELSE regexp_replace(m.m, '[^A-Za-z0-9]+', '', 'g') END), 1, 24)
            ELSE s.segment END AS segment,
       CASE WHEN m.m IS NOT NULL THEN 'model' ELSE 'heuristic' END AS source
FROM seg s LEFT JOIN model m USING (folder)""")
def q_lookup_or_default(spark, d):
    files = _files(spark, d)
    cands = FO.suspicious_folders(files)
    seg = FO.heuristic_segment(cands, files)
    replies = _folder_replies(cands).withColumnRenamed("folder", "asked")
    parsed = I.parse_folder_segments(replies, ["asked"]).select("folder", "new_segment")
    return FO.lookup_or_default(seg, parsed).select("folder", "segment", "source")
