"""Scanner queries over five Java templates, their units and signals written out by hand (registered on import).

Every page gives one file of template ``page_id % 5``: annotations with arguments inside arguments, char literals and
quotes, text blocks, do-while, enum constants with bodies, records, anonymous classes, a member the scanner cannot
read and a file that does not close.  The SQL lists what must come out; it parses nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from legible.operators import extract as E
from legible.plans import jobs as J
from legible.plans.catalog import register
from legible.sources.tables import table

TEMPLATES = [
    """package t.k0;
/** Doc. */
@Deprecated @Named(value = @Inner("b{"), on = {1, 2})
public class Alpha# extends Base {
  private final int[] a = {1, 2};  // "not a literal" { (
  public Alpha#(String s, char c) { super(s); this.go('"', "x\\"y"); String q = "'"; }
  @Get(value = @Path("p(q)"))
  public <T extends Comparable<T>> java.util.List<T> find(@Nullable("n") Map<String, T> m, int[] ids) throws java.io.IOException {
    do { step(); } while (more());
    for (int i : ids) { if (i > 0) add(new Item(i)); else skip("a;b", '\\''); }
    return null; /* for (while) if */
  }
}
""",
    """package t.k1;
interface Beta# { int one(String s); default void two() { run(() -> { a(); b(); }); } interface Marker# { } }
enum Color# { RED(1) { int z() { return 9; } }, BLUE(2); private final int v; Color#(int v) { this.v = v; } int z() { return v; } }
record Point#(int x, int y) { Point# { check(x); } int sum() { return x + y; } }
""",
    """package t.k2;
class Gamma# {
  static { boot(); }
  Runnable r = () -> { later(); };
  static class In { void deep() throws A, B { try { x(); } catch (E e) { y(); } finally { z(); } while (w()) v(); } }
  String text() { return \"\"\"
      "quoted" { ( // not code
      \"\"\" + "tail"; }
  int pick(int k) {
    switch (k) { case 1: return f(k); default: }
    Object o = new Object() { public String toString() { return name(); } };
    if (k > 1) { g(); } else if (k < 0) h(); else { i(); }
    return k;
  }
}
""",
    """package t.k3;
class Delta# { int ok() { return 1; } int 9bad(int a) { return 2; } abstract long last(); }
""",
    """package t.k4;
class Eps# { void open() { if (a) {
""",
]

#: (template, kind, signature, declaration, loops, conditionals, statements, calls, literals); '#' stands for the page id.
UNITS = [
    (0, "ctor", "t.k0.Alpha#.Alpha#(String,char)", "Alpha#(String, char)", 0, 0, 3, "go", r'x\"y|' + "'"),
    (0, "method", "t.k0.Alpha#.find(Map<String, T>,int[])", "java.util.List<T> find(Map<String, T>, int[])", 2, 1, 3,
     "step,more,add,skip", "p(q)|n|a;b"),
    (1, "method", "t.k1.Beta#.one(String)", "int one(String)", 0, 0, 0, "", ""),
    (1, "method", "t.k1.Beta#.two()", "void two()", 0, 0, 1, "run,a,b", ""),
    (1, "class", "t.k1.Beta#.Marker#", "interface Marker#", None, None, None, None, ""),
    (2, "method", "t.k2.Gamma#.In.deep()", "void deep()", 1, 0, 2, "x,y,z,w,v", ""),
    (2, "method", "t.k2.Gamma#.text()", "String text()", 0, 0, 1, "", "tail"),
    (2, "method", "t.k2.Gamma#.pick(int)", "int pick(int)", 0, 3, 4, "f,name,g,h,i", ""),
    (3, "method", "t.k3.Delta#.ok()", "int ok()", 0, 0, 1, "", ""),
    (3, "method", "t.k3.Delta#.last()", "long last()", 0, 0, 0, "", ""),
    (3, "error", None, None, None, None, None, None, None),
    (4, "error", None, None, None, None, None, None, None),
]


def template_files(spark, d):
    one = F.get(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("page_id") % len(TEMPLATES)).cast("int"))
    key = F.col("page_id").cast("string")
    return table(spark, d, "pages", "page_id").select("page_id", F.concat(F.lit("t/"), key, F.lit(".java")).alias("rel_path"),
                                                      F.replace(one, F.lit("#"), key).alias("text"))


def _sql(v) -> str:
    return "NULL" if v is None else str(v) + "::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


SQL_TEMPLATES = ("WITH want(k, unit_kind, sig, decl, loops, conditionals, size, calls, literals) AS (VALUES %s) "
                 "SELECT 't/' || page_id || '.java' AS file, unit_kind, replace(sig, '#', page_id::VARCHAR) AS qualified_signature, "
                 "replace(decl, '#', page_id::VARCHAR) AS decl, loops, conditionals, size, calls, literals "
                 "FROM pages JOIN want ON page_id %% 5 = k" % ", ".join("(%s)" % ", ".join(map(_sql, u)) for u in UNITS))


@register("analyze_java_templates", SQL_TEMPLATES)
def q_analyze_java_templates(spark, d):
    _, units, rejects = J.analyze_job(template_files(spark, d))
    # the signals of a unit's body: its code follows its declaration
    body = F.substr("code", F.length("decl") + 2)
    s = E.behavior_signals(body, size="n_statements")
    has_body = F.col("unit_kind") != "class"

    def when_body(c):
        return F.when(has_body, c)
    rows = units.select("file", "unit_kind", "qualified_signature", "decl", when_body(s["loops"].cast("bigint")).alias("loops"),
                        when_body(s["conditionals"].cast("bigint")).alias("conditionals"), when_body(s["size"].cast("bigint")).alias("size"),
                        when_body(F.array_join(s["calls"], ",")).alias("calls"), F.array_join("strings", "|").alias("literals"))
    none = F.lit(None)
    return rows.unionByName(rejects.select("file", F.lit("error").alias("unit_kind"), *[none.cast(t).alias(c) for c, t in rows.dtypes[2:]]))


@register("string_hint", "WITH want(k, sig, literals) AS (VALUES %s) SELECT replace(sig, '#', page_id::VARCHAR) AS qualified_signature, "
          "CASE WHEN literals = '' THEN '' ELSE 'strings: ' || replace(literals, '|', ' | ') END AS hint "
          "FROM pages JOIN want ON page_id %% 5 = k" % ", ".join("(%s)" % ", ".join(map(_sql, (u[0], u[2], u[8]))) for u in UNITS if u[2]))
def q_string_hint(spark, d):
    """The line of literals in every unit's prompt block."""
    from legible.operators.infer import prompt_block
    _, units, _ = J.analyze_job(template_files(spark, d))
    return prompt_block(units).select("qualified_signature", F.regexp_extract("block", "(?m)^strings: .*$", 0).alias("hint"))


@register("method_snippets", "WITH want(k, sig) AS (VALUES %s) SELECT 't/' || page_id || '.java' AS file, count(*)::BIGINT AS n_methods "
          "FROM pages JOIN want ON page_id %% 5 = k GROUP BY page_id" % ", ".join("(%s)" % ", ".join(map(_sql, (u[0], u[2]))) for u in UNITS if u[1] == "method"))
def q_method_snippets(spark, d):
    _, units, _ = J.analyze_job(template_files(spark, d))
    return E.method_snippets(units).groupBy("file").agg(F.count("snippet").alias("n_methods"))


@register("format_totals", "SELECT CASE WHEN page_id % 5 = 4 THEN 'fail' ELSE 'ok' END AS status, count(*)::BIGINT AS n_files FROM pages GROUP BY 1")
def q_format_totals(spark, d):
    decls, _, _ = J.analyze_job(template_files(spark, d))
    return E.scan_totals(decls)
