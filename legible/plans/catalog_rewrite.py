"""Rewriting queries whose expected texts are written out in SQL (registered on import).

``linked_sources`` makes one Java file per page that imports, declares and uses another page's class, calls its own
methods and reads a field; every other file has CRLF line ends.  The mapping swaps the two classes of a pair, chains
``get -> set -> put``, renames the field and swaps two short names.  The SQL fills a template with the expected names:
it contains no rewriting at all.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from legible.operators import rewrite as R
from legible.operators.spans import apply_spans
from legible.plans.catalog import docs, register
from legible.session import cut_lineage
from legible.sources.tables import table

#: name slots of the template and what they hold before any rewriting
PLAIN = {"imp": "p.pkg || '.' || p.cls", "own": "s.cls", "other": "p.cls", "get": "'get'", "set": "'set'", "fld": "'a0'",
         "arg": "'s'", "one": "'x'", "two": "'y'"}
#: what the whole mapping makes of them
ALL = PLAIN | {"imp": "p.pkg || '.' || s.cls", "own": "p.cls", "other": "s.cls", "get": "'set'", "set": "'put'", "fld": "'count'",
               "arg": "'input'", "one": "'y'", "two": "'x'"}


def _template(slots: dict[str, str], paired: str) -> str:
    """The text as a concatenation valid in Spark SQL and DuckDB; ``s`` is the file's page, ``p`` its partner."""
    v = slots
    nl = "s.nl"
    lines = ["'package ' || s.pkg || ';'",
             f"CASE WHEN {paired} THEN 'import ' || {v['imp']} || ';' ELSE '// alone' END",
             "'  import java.util.List ;'",
             f"'class ' || {v['own']} || ' {{'",
             f"'  private int ' || {v['fld']} || ';'",
             f"CASE WHEN {paired} THEN '  ' || {v['other']} || ' p;' ELSE '' END",
             f"'  int ' || {v['get']} || '(int ' || {v['arg']} || ') {{ return ' || {v['set']} || '(' || {v['fld']} || ', ' || {v['arg']} || ') + this.' || {v['fld']} || '; }}'",
             f"'  int ' || {v['set']} || '(int ' || {v['one']} || ', int ' || {v['two']} || ') {{ return ' || {v['one']} || ' + ' || {v['two']} || '; }}'",
             f"'  // reader and writer of ' || {v['own']} || ', getset a0x'",
             "'}'"]
    return " || ".join(f"{line} || {nl}" for line in lines)


# one page: its class, package and line end; pairs are (0, 1), (2, 3), ...
_PAGE = ("SELECT page_id, 'Doc' || coalesce({hash}, '') || '_' || page_id AS cls, 'app.g' || (page_id % 7) AS pkg, "
         "CASE WHEN page_id % 2 = 1 THEN {crlf} ELSE {lf} END AS nl, "
         "CASE WHEN page_id % 2 = 1 THEN page_id - 1 ELSE page_id + 1 END AS mate FROM pages")
_DUCK_PAGE = _PAGE.format(hash="upper(substr(regexp_extract(html, '<title>([a-zA-Z]*)', 1), 1, 1))", crlf="chr(13) || chr(10)", lf="chr(10)")


def linked_sources(spark, d):
    p = table(spark, d, "pages", "page_id", "html")
    odd = F.col("page_id") % 2 == 1
    page = p.select("page_id", F.concat(F.lit("Doc"), F.upper(F.substring(F.regexp_extract("html", "<title>([a-zA-Z]*)", 1), 1, 1)),
                                        F.lit("_"), F.col("page_id").cast("string")).alias("cls"),
                    F.concat(F.lit("app.g"), (F.col("page_id") % 7).cast("string")).alias("pkg"),
                    F.when(odd, F.lit("\r\n")).otherwise(F.lit("\n")).alias("nl"),
                    F.when(odd, F.col("page_id") - 1).otherwise(F.col("page_id") + 1).alias("mate"))
    both = page.alias("s").join(page.select(F.col("page_id").alias("mate"), "cls", "pkg").alias("p"), "mate", "left")
    path = "replace(s.pkg, '.', '/') || '/' || s.cls || '.java'"
    return both.selectExpr("s.page_id", "s.pkg", "s.cls", "p.cls AS mate_cls", f"{path} AS rel_path",
                           _template(PLAIN, "p.cls IS NOT NULL") + " AS text")


def linked_mapping(files):
    """Rules of every kind, from the files' own names."""
    fqn = F.concat("pkg", F.lit("."), "cls")

    def rule(kind, old, new, prio):
        return F.struct(F.lit(kind).alias("kind"), old.alias("old_key"), new.alias("new_name"), F.lit(prio).cast("bigint").alias("prio"))
    own = F.array(rule("class", F.when(F.col("mate_cls").isNotNull(), fqn), F.concat("pkg", F.lit("."), "mate_cls"), 0),
                  rule("method", F.concat(fqn, F.lit(".get(int)")), F.lit("set"), 1),
                  rule("method", F.concat(fqn, F.lit("#set(..)")), F.lit("put"), 2),
                  rule("field", F.concat(fqn, F.lit("#a0")), F.lit("count"), 3))
    short = files.sparkSession.range(1).select(F.inline(F.array(
        *[rule("simple", F.lit(o), F.lit(n), i) for i, (o, n) in enumerate([("s", "input"), ("x", "y"), ("y", "x"), ("a0", "lost")])])))
    return files.select(F.inline(own)).filter("old_key is not null").unionByName(short)


def _expected(slots, columns, tail=""):
    return (f"WITH page AS ({_DUCK_PAGE}) SELECT s.page_id, " + _template(slots, "p.cls IS NOT NULL") + f" AS new_text, {columns} "
            "FROM page s LEFT JOIN page p ON p.page_id = s.mate" + tail)


_LONE = "CASE WHEN p.cls IS NULL THEN {} ELSE {} END::BIGINT"
# a file without a partner keeps its own class name
_ALONE = {k: f"CASE WHEN p.cls IS NULL THEN {PLAIN[k]} ELSE {ALL[k]} END" for k in ("own",)}


@register("apply_all_kinds", _expected(ALL | _ALONE, ", ".join([
    _LONE.format(0, 1) + " AS n_import", _LONE.format(0, 3) + " AS n_class", "3::BIGINT AS n_method", "3::BIGINT AS n_field",
    "6::BIGINT AS n_simple", _LONE.format(12, 16) + " AS n_replacements"])))
def q_apply_all_kinds(spark, d):
    from legible.plans.jobs import apply_job
    files = linked_sources(spark, d)
    out = apply_job(files, linked_mapping(files))
    return out.select("page_id", "new_text", *[F.col("hits." + k).alias("n_" + k) for k in ("import", "class", "method", "field", "simple")],
                      "n_replacements")


@register("rewrite_imports", _expected(PLAIN | {"imp": ALL["imp"]}, _LONE.format(0, 1) + " AS n_imports"))
def q_rewrite_imports(spark, d):
    files = linked_sources(spark, d)
    rules = cut_lineage(linked_mapping(files).filter("kind = 'class'"))
    return R.rewrite_imports(files, rules).select("page_id", "new_text", "n_imports")


@register("rewrite_class_names", _expected(PLAIN | {k: ALL[k] for k in ("imp", "other")} | _ALONE, _LONE.format(0, 4) + " AS n_replacements"))
def q_rewrite_class_names(spark, d):
    files = linked_sources(spark, d)
    rules = cut_lineage(linked_mapping(files).filter("kind = 'class'"))
    return R.rewrite_class_names(files, rules).select("page_id", "new_text", "n_replacements")


@register("rewrite_fields", _expected(PLAIN | {"fld": ALL["fld"]}, "3::BIGINT AS n_replacements"))
def q_rewrite_fields(spark, d):
    files = linked_sources(spark, d)
    rules = cut_lineage(linked_mapping(files).filter("kind = 'field'"))
    return apply_spans(files, rules).select("page_id", "new_text", "n_replacements")


# every ASCII identifier of four or more small letters that occurs is a key (thousands of rules), some twice; odd keys match nothing
LARGE_KEY = "[a-z]{4,}"


@register("rewrite_tokens_large", r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+') AS toks FROM documents)
SELECT doc_id, array_to_string(list_transform(toks, lambda t: CASE WHEN regexp_full_match(t, '[a-z]{4,}')
         THEN upper(t) || '_' || length(t) ELSE t END), '') AS new_text,
       len(list_filter(toks, lambda t: regexp_full_match(t, '[a-z]{4,}')))::BIGINT AS n_replacements
FROM d""")
def q_rewrite_tokens_large(spark, d):
    files = docs(spark, d, "doc_id", "text")
    words = cut_lineage(files.select(F.explode(F.regexp_extract_all("text", F.lit(R.IDENT_RUN), 0)).alias("w")).filter(
        F.col("w").rlike("^%s$" % LARGE_KEY)).groupBy("w").count())
    right = words.select(F.col("w").alias("old_key"), F.concat(F.upper("w"), F.lit("_"), F.length("w").cast("string")).alias("new_name"),
                         F.lit(0).alias("prio"))
    again = words.filter(F.length("w") % 2 == 0).select(F.col("w").alias("old_key"), F.lit("late").alias("new_name"), F.lit(1).alias("prio"))
    odd = words.select(F.explode(F.array(F.concat("w", F.lit(".")), F.concat(F.lit("é"), "w"), F.lit(""), F.lit(None))).alias("old_key"),
                       F.lit("odd").alias("new_name"), F.lit(0).alias("prio"))
    rules = right.unionByName(again).unionByName(odd)
    return R.rewrite_tokens(files, rules).select("doc_id", "new_text", "n_replacements")


# A10 with one package per order (15,000 at sf0.01): an order's customer imports from it, plain, static and with a wildcard
_ORDER_LINE = "'import {st}com.shop.o' || {key} || {tail} || ';' || chr(10)"


@register("rewrite_import_prefix_large", r"""
WITH l AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '.Item' WHEN 1 THEN '.*' ELSE '.inner.Deep' END AS tail,
                  CASE WHEN o_orderkey % 5 = 0 THEN 'static ' ELSE '' END AS st FROM orders)
SELECT o_custkey AS file_id,
       string_agg('import ' || st || CASE WHEN o_orderkey % 4 = 0 THEN 'com.shop.o' ELSE 'net.store.p' END || o_orderkey || tail || ';' || chr(10), ''
                  ORDER BY o_orderkey) || 'import com.shop.Other;' AS new_text,
       count(*) FILTER (WHERE o_orderkey % 4 <> 0)::BIGINT AS n_import_changes
FROM l GROUP BY o_custkey""")
def q_rewrite_import_prefix_large(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    key = F.col("o_orderkey").cast("string")
    tail = F.when(F.col("o_orderkey") % 3 == 0, ".Item").when(F.col("o_orderkey") % 3 == 1, ".*").otherwise(".inner.Deep")
    line = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "import static com.shop.o").otherwise("import com.shop.o"), key, tail, F.lit(";\n"))
    files = (o.select("o_custkey", F.struct("o_orderkey", line.alias("line")).alias("l")).groupBy("o_custkey")
             .agg(F.sort_array(F.collect_list("l")).alias("ls"))
             .select(F.col("o_custkey").alias("file_id"), F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), ""),
                                                                   F.lit("import com.shop.Other;")).alias("text")))
    pm = o.filter("o_orderkey % 4 <> 0").select(F.concat(F.lit("com.shop.o"), key).alias("old_pkg"),
                                                F.concat(F.lit("net.store.p"), key).alias("new_pkg"), F.col("o_orderkey").alias("prio"))
    return R.rewrite_import_prefix(files, pm).select("file_id", "new_text", "n_import_changes")
