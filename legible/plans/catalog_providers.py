"""Provider queries: replies that fail, fall short, run over or stay blank, with SQL for what must remain (registered on import)."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from legible.operators import infer as I
from legible.plans import jobs as J
from legible.plans.catalog import register
from legible.plans.catalog_folders import SQL_FILES, SQL_IMPORTS, _sql_pkg, page_files
from legible.plans.catalog_java import _annotate_sql, java_sources

QUICK = I.RetryPolicy(tries=2, initial_ms=1, jitter_ms=0)


class SayingDocs:
    """Says the first line of each snippet; by the length of the call's first line it fails, falls short, adds a text or
    leaves one blank."""

    def __call__(self, prompts: list[str]) -> list[str]:
        heads = [re.search(r"```java\n(.*)", p)[1].strip() for p in prompts]
        out = ["Says " + h for h in heads]
        kind = len(heads[0]) % 4
        if kind == 0:
            raise RuntimeError("bad request")
        if kind == 1:
            return out[:-1]
        if kind == 2:
            return out + ["one too many"]
        return ["  " if i == 1 else x for i, x in enumerate(out)]


class NamingFolders:
    """Names folders whose key has an even length; fails for calls whose first key's length is a multiple of three."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            keys = re.findall(r"^- key: (.*?) \| package: ", p, flags=re.M)
            if len(keys[0]) % 3 == 0:
                raise RuntimeError("bad request")
            reply = json.dumps({k: {"newSegment": "Mod-" + k.split("/")[-1]} for k in keys if len(k) % 2 == 0})
            out.append("Here:\n```json\n" + reply + "\n```")
        return out


@register("annotate_provider", _annotate_sql(model=True))
def q_annotate_provider(spark, d):
    files = java_sources(spark, d)
    decls, _, _ = J.analyze_job(files)
    opts = J.Options(doc_provider=SayingDocs(), policy=QUICK)
    return J.annotate_job(files, decls, opts).select("rel_path", "new_text", "n_docs", "n_model")


_SEG = """calls AS (SELECT folder, (row_number() OVER (ORDER BY folder) - 1) // 3 AS call_no FROM cands),
asked AS (SELECT folder, min(folder) OVER (PARTITION BY call_no) AS h0 FROM calls),
seg2 AS (SELECT s.folder, s.parent, length(h0) % 3 <> 0 AND length(s.folder) % 2 = 0 AS named,
                CASE WHEN length(h0) % 3 <> 0 AND length(s.folder) % 2 = 0
                     THEN substr('mod' || lower(regexp_replace(regexp_extract(s.folder, '[^/]*$', 0), '[^A-Za-z0-9]+', '', 'g')), 1, 24)
                     ELSE s.segment END AS segment FROM seg s JOIN asked USING (folder)),
anc AS ("""


def _with_replies(sql: str) -> str:
    return sql.replace("anc AS (", _SEG, 1).replace("FROM seg s LEFT JOIN sib b", "FROM seg2 s LEFT JOIN sib b")


def _folder_options():
    return J.Options(folder_provider=NamingFolders(), folders_per_call=3, policy=QUICK)


@register("folder_plan_provider", _with_replies(SQL_FILES) + """
SELECT folder, new_folder, CASE WHEN named THEN 'model' ELSE 'heuristic' END AS source FROM plan JOIN seg2 USING (folder)""")
def q_folder_plan_provider(spark, d):
    return J.folder_plan(page_files(spark, d), _folder_options()).select("folder", "new_folder", "source")


@register("package_refactor_provider", _with_replies(SQL_IMPORTS) + r"""
SELECT r.page_id, coalesce(p.new_folder, r.folder) || '/' || r.file_name AS new_path,
       regexp_replace(r.new_text, '^\s*package\s+[^;]+;', 'package ' || %s || ';') AS new_text
FROM rewritten r LEFT JOIN plan p USING (folder)""" % _sql_pkg("coalesce(p.new_folder, r.folder)"))
def q_package_refactor_provider(spark, d):
    return J.package_refactor_job(page_files(spark, d), normalize_all=True, opts=_folder_options())[0].select("page_id", "new_path", "new_text")


class Naming:
    """Names every method of a prompt ``m_<old name>``, in the field names some models prefer."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            methods = re.findall(r"^methodName: (\S+)$", p, flags=re.M)
            out.append(json.dumps({"items": [{"type": "method", "oldName": n, "newName": "m_" + n} for n in methods]}))
        return out



# a method name answered anywhere renames the methods of that name; all replies agree, so the order of calls does not show
@register("provider_mapping", """
WITH m AS (SELECT DISTINCT 'get' || (page_id % 5) AS name, page_id FROM pages)
SELECT 'method' AS kind, 'q.P' || page_id || '.' || name || '(int)' AS old_key, 'm_' || name AS new_name FROM m""")
def q_provider_mapping(spark, d):
    """suggest_job with a provider: packed prompts, saved replies, parsing, resolving (model rules only)."""
    from legible.sources.tables import table
    key = F.col("page_id").cast("string")
    text = F.concat(F.lit("package q;\nclass P"), key, F.lit(" { int get"), (F.col("page_id") % 5).cast("string"), F.lit("(int a) { return a; } }\n"))
    files = table(spark, d, "pages", "page_id").select(F.concat(F.lit("q/P"), key, F.lit(".java")).alias("rel_path"), text.alias("text"))
    _, units, _ = J.analyze_job(files)
    mapping = J.suggest_job(units, J.Options(provider=Naming(), policy=QUICK, token_budget=400, max_items=7))
    return mapping.filter("source = 'model'").select("kind", "old_key", "new_name")


class Fails:
    """Fails for passing reasons on prompts of ``conv_id % 3 = 0`` until ``mend`` is set, for good on ``% 3 = 1``."""

    def __init__(self, mend: bool = False):
        self.mend = mend

    def __call__(self, prompts: list[str]) -> list[str]:
        k = int(prompts[0].split()[0]) % 3
        if k == 0 and not self.mend:
            raise RuntimeError("503 service unavailable")
        if k == 1:
            raise RuntimeError("bad request")
        return ["ok " + p for p in prompts]


@register("retry_failed_batches", """
SELECT conv_id, CASE WHEN conv_id % 3 <> 1 THEN 'ok ' || conv_id || ' ' || count(*) END AS reply,
       CASE WHEN conv_id % 3 = 1 THEN 'bad request' END AS error FROM conversations GROUP BY conv_id""")
def q_retry_failed_batches(spark, d):
    """The first run's passing failures are asked again; replies and lasting errors stay."""
    from legible.session import cut_lineage
    from legible.sources.tables import table
    prompts = table(spark, d, "conversations", "conv_id").groupBy("conv_id").agg(
        F.concat(F.first("conv_id").cast("string"), F.lit(" "), F.count(F.lit(1)).cast("string")).alias("prompt"))
    prompts = cut_lineage(prompts)
    once = I.RetryPolicy(tries=1)
    first = cut_lineage(I.batch_infer(prompts, Fails(), ["conv_id"], concurrency=4, policy=once))
    return I.retry_failed(first, prompts, Fails(mend=True), ["conv_id"], policy=once).select("conv_id", "reply", "error")
