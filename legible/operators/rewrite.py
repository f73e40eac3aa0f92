"""Rewriting operators (A1-A14, J6, J10): apply a rename mapping to every file.

Every form rewrites a text where it stands.  The size of the mapping only picks how a row learns its rules:

* up to ``MAP_LITERAL_MAX`` rules: one alternation of the keys, a narrow projection in whole-stage codegen;
* above: the row's distinct identifiers are looked up (``lookup.with_map``: a constant behind a measured bound,
  beyond it a salted join that gives every row its own small map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legible.functions.text import IDENT_CLASS, class_fqn, fqn_from_path
from legible.operators.lookup import at, let, with_map
from legible.operators.spans import apply_spans, first_rules, identifiers
from legible.operators.util import bounded_collect
from legible.session import cut_lineage

MAP_LITERAL_MAX = 256        # rules inlined as a map literal (Spark map lookup is a linear scan)
CASCADE_MAX = 200            # rules applied as a chain of regexp_replace (plan size grows per rule)

IDENT_RUN = "[%s]+" % IDENT_CLASS
TOKENS = "[%s]+|[^%s]+" % (IDENT_CLASS, IDENT_CLASS)   # identifier runs and the text between them
KIND_ORDER = {"import": 0, "class": 1, "method": 2, "field": 3, "simple": 4}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_quote(s: str) -> str:
    """Literal text inside a Java regex."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def repl_escape(s: str) -> str:
    """Literal replacement string for Java's regexp_replace ($ and \\ escaped)."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def boundary(word: str) -> str:
    return "(?<![%s])%s(?![%s])" % (IDENT_CLASS, java_quote(word), IDENT_CLASS)


def map_literal(pairs: list[tuple[str, str]]) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def tokens_of(text) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKENS), 0)


def keys_regex(keys: list[str]) -> str:
    """One regex matching any key as a whole identifier token (longest keys first)."""
    alt = "|".join(java_quote(k) for k in sorted(set(keys), key=lambda k: (-len(k), k)))
    return "(?<![%s])(?:%s)(?![%s])" % (IDENT_CLASS, alt, IDENT_CLASS)


def rewrite_with_map(text, m: Column, keys: list[str] | None = None) -> tuple[Column, Column]:
    """Simultaneous substitution of whole identifier tokens; returns (new_text, hits).

    With the key list known, the text is split on an alternation of the keys and the pieces are
    zipped with the mapped matches — only hits are materialised, not every token (about 2x faster
    than tokenising).  Without keys every identifier token is looked up."""
    t = _c(text)
    if keys is not None:
        if not keys:
            return t, F.when(t.isNull(), F.lit(None)).otherwise(F.lit(0).cast("bigint"))
        rx = keys_regex(keys)
        pieces = F.split(t, rx, -1)
        matches = F.regexp_extract_all(t, F.lit(rx), 0)
        repl = F.concat(F.transform(matches, lambda x: m[x]), F.array(F.lit("")))
        new = F.array_join(F.zip_with(pieces, repl, lambda p, r: F.concat(p, r)), "")
        return new, F.coalesce(F.size(matches), F.lit(0)).cast("bigint")
    toks = tokens_of(text)
    new = F.array_join(F.transform(toks, lambda x: F.coalesce(m[x], x)), "")
    hits = F.size(F.filter(toks, lambda x: m[x].isNotNull())).cast("bigint")
    return F.when(t.isNull(), F.lit(None)).otherwise(new), hits


def token_rules(rules: DataFrame, old_col: str = "old_key", new_col: str = "new_name") -> DataFrame:
    """One rule per identifier key."""
    order = [F.col(c) for c in ("prio", new_col) if c in rules.columns]
    return (rules.filter(F.col(old_col).rlike("^[%s]+$" % IDENT_CLASS) & F.col(new_col).isNotNull())
            .groupBy(old_col).agg(F.min_by(new_col, F.struct(*order)).alias(new_col)))


# A6 + A8
def rewrite_tokens(files: DataFrame, rules: DataFrame, key: str = "doc_id", text_col: str = "text",
                   old_col: str = "old_key", new_col: str = "new_name") -> DataFrame:
    """Add ``new_text`` and ``n_replacements`` (true token hits) to ``files``.

    A rule's key is a whole identifier token; other keys match nothing.  Of several rules for a key the first by
    ``prio`` (if the table has it), then by new name, holds.  Both are settled before the mapping's size picks a plan."""
    rules = token_rules(rules, old_col, new_col)
    rows = bounded_collect(rules.select(old_col, new_col), MAP_LITERAL_MAX)
    if rows is not None:
        pairs = sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None)
        new, hits = rewrite_with_map(text_col, map_literal(pairs), [k for k, _ in pairs])
        return files.withColumn("new_text", new).withColumn("n_replacements", hits)
    return rewrite_tokens_lookup(files, cut_lineage(rules), text_col, old_col, new_col)


def rewrite_tokens_lookup(files: DataFrame, rules: DataFrame, text_col: str = "text", old_col: str = "old_key",
                          new_col: str = "new_name") -> DataFrame:
    """Large-mapping form: the row's distinct identifiers -> one small map -> rewriting in place.

    No key column is used and no separator, position or token leaves its row."""
    mapped = with_map(files, identifiers(F.col(text_col)), rules, "_map", old_col, new_col)

    def both(m):        # identifiers only are looked up, each once; what a split leaves between them stays
        gaps, names = F.split(F.col(text_col), IDENT_RUN, -1), F.regexp_extract_all(F.col(text_col), F.lit(IDENT_RUN), 0)
        return let(F.transform(names, lambda x: F.struct(x.alias("x"), at(m, x).alias("new"))), lambda zs: F.struct(
            F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(zs)), zs, lambda g, z: F.concat(g, F.coalesce(z["new"], z["x"]))), ""),
                     F.element_at(gaps, -1)).alias("t"),
            F.size(F.filter(zs, lambda z: z["new"].isNotNull())).cast("bigint").alias("n")))
    same = F.struct(F.col(text_col).alias("t"), F.lit(0).cast("bigint").alias("n"))
    done = F.when(F.col(text_col).isNull() | (F.size("_map") == 0), same).otherwise(let(F.col("_map"), both))
    out = mapped.withColumn("_done", done)
    return out.select(*files.columns, F.col("_done.t").alias("new_text"), F.col("_done.n").alias("n_replacements"))


# A8 per rule
def count_replacements(files: DataFrame, rules: DataFrame, key: str = "doc_id", text_col: str = "text",
                       old_col: str = "old_key") -> DataFrame:
    """Matches per file and rule: ``(key, old_key, hits)`` for hits > 0.

    Small rule sets extract only the hits (one regex of the keys); large ones pre-aggregate all
    tokens per file and semi-join the rule table."""
    rules = rules.filter(F.col(old_col).rlike("^[%s]+$" % IDENT_CLASS))
    rows = bounded_collect(rules.select(old_col).distinct(), MAP_LITERAL_MAX)
    if rows is not None:
        keys = [r[0] for r in rows if r[0] is not None]
        if not keys:
            return files.select(key, F.lit(None).cast("string").alias(old_col), F.lit(0).cast("bigint").alias("hits")).limit(0)
        hits = files.select(key, F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")),
                                                                F.lit(keys_regex(keys)), 0)).alias(old_col))
        return hits.groupBy(key, old_col).agg(F.count(F.lit(1)).alias("hits"))
    toks = files.select(key, F.explode(tokens_of(text_col)).alias(old_col))
    per = toks.groupBy(key, old_col).agg(F.count(F.lit(1)).alias("hits"))
    return per.join(rules.select(old_col).distinct(), old_col, "left_semi").select(key, old_col, "hits")


# G7
def rewrite_totals(rewritten: DataFrame, group_cols: list[str], text_col: str = "text") -> DataFrame:
    changed = ~F.col("new_text").eqNullSafe(F.col(text_col))
    return rewritten.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.when(changed, 1).otherwise(0)).cast("bigint").alias("n_changed"),
        F.sum("n_replacements").cast("bigint").alias("n_replacements"))


def cascade_patterns(rules: list[dict]) -> list[tuple[str, str]]:
    """Regex rules in the reference order import -> class -> method -> field -> simple.

    Each rule is a dict with ``kind``, ``old``, ``new``; imports use fully qualified names."""
    out = []
    for r in sorted(rules, key=lambda r: (KIND_ORDER[r["kind"]], r.get("prio", 0))):
        old, new = r["old"], r["new"]
        if not old or not new or old == new:
            continue
        if r["kind"] == "import":
            out.append(("(?m)^[ \\t]*import[ \\t]+" + java_quote(old) + "[ \\t]*;[ \\t]*$",
                        repl_escape("import " + new + ";")))
        elif r["kind"] == "method":
            out.append(("(?<=\\W)" + java_quote(old) + "\\s*\\(", repl_escape(new + "(")))
        else:
            out.append((boundary(old), repl_escape(new)))
    return out


# A7
def rewrite_cascade(text, rules: list[dict]) -> Column:
    """Rules one after another over the already rewritten text (reproduces cascades)."""
    pats = cascade_patterns(rules)
    if len(pats) > CASCADE_MAX:
        raise ValueError("cascade limited to %d rules; use rewrite_tokens for large maps" % CASCADE_MAX)
    out = _c(text)
    for p, r in pats:
        out = F.regexp_replace(out, p, r)
    return out


# A1
def rewrite_imports(files: DataFrame, class_map: DataFrame, text_col: str = "text") -> DataFrame:
    """``import old;`` lines -> new FQN (whole-line match; the line end stays) for any number of class rules: add
    ``new_text`` and ``n_imports``."""
    out = apply_spans(files, class_map.withColumn("kind", F.lit("class")), text_col=text_col, kinds=("import",))
    return out.withColumnRenamed("n_replacements", "n_imports").drop("hits")


# A2
def rewrite_class_names(files: DataFrame, class_map: DataFrame, text_col: str = "text") -> DataFrame:
    """Simple class names as whole tokens, for any number of class rules: add ``new_text`` and ``n_replacements``."""
    return apply_spans(files, class_map.withColumn("kind", F.lit("class")), text_col=text_col, kinds=("class",)).drop("hits")


# A3 + A4 (rules keyed by their owner, J6: ``spans.owner_members``)
def rewrite_owned(files: DataFrame, mapping: DataFrame, path_col: str = "rel_path", text_col: str = "text",
                  owner_col: Column | None = None) -> DataFrame:
    """Method and field rules only in the file whose path-derived FQN is the owner: add ``owner``, ``new_text`` and
    ``n_replacements``."""
    own = owner_col if owner_col is not None else fqn_from_path(path_col)
    return apply_spans(files, mapping, path_col, text_col, own, ("method", "field")).drop("hits").withColumn("owner", own)


# A9
def rewrite_package_line(text, new_pkg) -> Column:
    """Replace the first ``package …;`` line."""
    return F.regexp_replace(_c(text), "(?s)\\A(.*?)(?m:^)\\s*package\\s+[^;]+;",
                            F.concat(F.lit("$1package "), F.regexp_replace(_c(new_pkg), "\\$", "\\\\\\$"),
                                     F.lit(";")))


IMPORT_LINE = "^\\s*import\\s+(?:static\\s+)?([A-Za-z_$][\\w$]*(?:\\.[\\w$*]+)*)"
IMPORT_HEAD = "^\\s*import\\s+(static\\s+)?"


def _import_name(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("import")), F.regexp_extract(line, IMPORT_LINE, 1)).otherwise(F.lit(""))


def _prefixes(name: Column) -> Column:
    """Proper dotted prefixes of an imported name: ``a.b.C`` -> ``a``, ``a.b``."""
    return let(F.split(name, "\\."), lambda parts: F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).otherwise(
            F.array().cast("array<string>")))


# A10
def rewrite_import_prefix(files: DataFrame, pkg_map: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """``import oldPkg.`` -> ``import newPkg.`` at line start, for any size of package map: add ``new_text`` and
    ``n_import_changes``.

    Every dotted prefix of the imported names in a row is looked up in the row; of several that are mapped the earliest
    map entry (by ``prio``) wins.  ``import static`` lines are handled too (the keyword is kept).  ``key`` is not used."""
    lines = F.split(F.col(text_col), "\n", -1)
    asked = F.array_distinct(F.flatten(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda ln: _prefixes(_import_name(ln)))))
    rules = (pkg_map.filter("old_pkg is not null and new_pkg is not null")
             .groupBy("old_pkg").agg(F.min(F.struct("prio", "new_pkg")).alias("rule")))
    mapped = with_map(files, asked, cut_lineage(rules), "_pk", "old_pkg", "rule")

    def renamed(line: Column, best: Column) -> Column:
        head = F.length(F.regexp_extract(line, IMPORT_HEAD, 0)) + F.length(best["old"])
        return F.concat(F.lit("import "), F.regexp_extract(line, IMPORT_HEAD, 1), best["new"], F.substr(line, head + 1))

    def one(m):
        def line(ln):
            found = F.filter(F.transform(_prefixes(_import_name(ln)), lambda p: F.struct(
                at(m, p)["prio"].alias("prio"), p.alias("old"), at(m, p)["new_pkg"].alias("new"))), lambda z: z["new"].isNotNull())
            return let(F.array_min(found), lambda b: F.struct(F.when(b.isNull(), ln).otherwise(renamed(ln, b)).alias("t"), b.isNotNull().alias("hit")))
        return let(F.transform(F.split(F.col(text_col), "\n", -1), line), lambda ls: F.struct(
            F.array_join(F.transform(ls, lambda z: z["t"]), "\n").alias("t"), F.size(F.filter(ls, lambda z: z["hit"])).cast("bigint").alias("n")))

    same = F.struct(F.col(text_col).alias("t"), F.lit(0).cast("bigint").alias("n"))
    done = F.when(F.col(text_col).isNull() | (F.size("_pk") == 0), same).otherwise(let(F.col("_pk"), one))
    out = mapped.withColumn("_done", done)
    return out.select(*files.columns, F.col("_done.t").alias("new_text"), F.col("_done.n").alias("n_import_changes"))


# ---------------------------------------------------------------- offsets and splicing inside a row

SUM_BLOCK, TEXT_BLOCK = 64, 1024


def starts_of(lengths) -> Column:
    """Exclusive running sums of an array: where each of consecutive pieces begins.  Sums of blocks first, then inside
    a block, so a row with many pieces costs little more than one pass."""
    def total(xs):
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def inside(ls, base):
        return F.transform(ls, lambda x, i: F.get(base, F.floor(i / SUM_BLOCK).cast("int")) + total(
            F.slice(ls, F.floor(i / SUM_BLOCK).cast("int") * SUM_BLOCK + 1, i % SUM_BLOCK)))

    def blocks(ls):
        count = F.ceil(F.size(ls) / SUM_BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(ls, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK))))
        bases = let(sums, lambda s: F.transform(s, lambda x, b: total(F.slice(s, F.lit(1), b))))
        return F.when(F.size(ls) == 0, ls).otherwise(let(bases, lambda base: inside(ls, base)))
    return let(F.transform(_c(lengths), lambda x: x.cast("int")), blocks)


def token_spans(text, token_regex: str) -> Column:
    """Array of (start, end, tok): code-point offsets of the identifier tokens that fully match ``token_regex`` (a pattern
    of identifier characters), from the lengths of what a split leaves between them."""
    rx = "(?<![%s])(?:%s)(?![%s])" % (IDENT_CLASS, token_regex, IDENT_CLASS)
    t = F.coalesce(_c(text), F.lit(""))
    pairs = F.arrays_zip(F.split(t, rx, -1).alias("gap"), F.regexp_extract_all(t, F.lit(rx), 0).alias("tok"))

    def spans(z):
        step = F.transform(z, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["tok"]), F.lit(0)))
        found = F.zip_with(z, starts_of(step), lambda x, at: F.struct(
            (at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + F.length(x["tok"])).alias("end"), x["tok"].alias("tok")))
        return F.filter(found, lambda x: x["tok"].isNotNull())
    return let(pairs, spans)


def splice(text, spans) -> Column:
    """``spans``: array<struct<start:int,end:int,new:string>> sorted by start (0-based, end exclusive).

    Each span contributes the gap since the previous span's end plus its replacement.  The text is cut into blocks
    once and a gap is taken from its own blocks, so the cost is linear in the text and the span count."""
    def build(z):
        sp, blocks = z["sp"], z["bl"]

        def between(a, b):
            p, q = F.floor(a / TEXT_BLOCK).cast("int"), F.floor(b / TEXT_BLOCK).cast("int")
            first, last = F.coalesce(F.get(blocks, p), F.lit("")), F.coalesce(F.get(blocks, q), F.lit(""))
            return F.when(p == q, F.substr(first, a % TEXT_BLOCK + 1, b - a)).otherwise(F.concat(
                F.substr(first, a % TEXT_BLOCK + 1), F.array_join(F.slice(blocks, p + 2, q - p - 1), ""), F.substr(last, F.lit(1), b % TEXT_BLOCK)))

        def prev_end(i):
            return F.when(i == 0, F.lit(0)).otherwise(F.get(sp, i - 1)["end"])
        pieces = F.transform(sp, lambda s, i: F.concat(between(prev_end(i), s["start"]), s["new"]))
        end = F.when(F.size(sp) == 0, F.lit(0)).otherwise(F.element_at(sp, -1)["end"])
        return F.concat(F.array_join(pieces, ""), between(end, z["n"]))
    t = _c(text)
    cut = F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % TEXT_BLOCK), 0)
    return F.when(t.isNotNull(), let(F.struct(_c(spans).alias("sp"), cut.alias("bl"), F.length(t).alias("n")), build))


# A12
def rewrite_occurrences(files: DataFrame, occurrences: DataFrame, mapping: DataFrame,
                        key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences ``(key, start, end, kind, old_key)`` joined to the mapping on (kind, old_key),
    then spliced per file in span order."""
    hits = occurrences.join(mapping.select("kind", "old_key", "new_name"), ["kind", "old_key"])
    per_file = hits.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"),
                                             F.col("end").cast("int").alias("end"),
                                             F.col("new_name").alias("new")))).alias("_spans"),
        F.count(F.lit(1)).cast("bigint").alias("n_replacements"))
    j = files.join(per_file, key, "left")
    return (j.withColumn("new_text", F.when(F.col("_spans").isNull(), F.col(text_col))
                         .otherwise(splice(text_col, "_spans")))
             .withColumn("n_replacements", F.coalesce("n_replacements", F.lit(0).cast("bigint")))
             .drop("_spans"))


def token_occurrences(files: DataFrame, token_regex: str, kind: str, key: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Spans (code-point offsets) of identifier tokens that fully match ``token_regex``, one row per occurrence; they are
    found inside the row, so only (key, start, end, token) leaves it."""
    found = files.select(key, F.inline(token_spans(text_col, token_regex)))
    return found.select(key, F.lit(kind).alias("kind"), F.col("tok").alias("old_key"), "start", "end")


def rewrite_token_spans(files: DataFrame, token_regex: str, mapping: DataFrame, kind: str = "simple", text_col: str = "text") -> DataFrame:
    """A12 without leaving the row: the occurrences of tokens that match ``token_regex`` and have a rule of ``kind`` are
    found, looked up and spliced where the text is; adds ``new_text`` and ``n_replacements``."""
    spans = files.withColumn("_spans", token_spans(text_col, token_regex))
    rules = mapping.filter(F.col("kind") == kind).select("old_key", "new_name").filter("old_key is not null and new_name is not null")
    rules = rules.groupBy("old_key").agg(F.min("new_name").alias("new_name"))
    out = with_map(spans, F.transform("_spans", lambda x: x["tok"]), rules, "_map")

    def hits(m):
        return F.filter(F.transform("_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), at(m, x["tok"]).alias("new"))),
                        lambda x: x["new"].isNotNull())
    out = out.withColumn("_hits", let(F.col("_map"), hits))
    return out.select(*files.columns, F.when(F.size("_hits") == 0, F.col(text_col)).otherwise(splice(text_col, "_hits")).alias("new_text"),
                      F.size("_hits").cast("bigint").alias("n_replacements"))


# A13
def rename_file_for_type(files: DataFrame, mapping: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """A file named after a renamed top type gets the type's new simple name."""
    cls = mapping.filter(F.col("kind") == "class").select(F.col("old_key").alias("_fqn"),
                                                          F.substring_index("new_name", ".", -1).alias("_new"))
    f = files.withColumn("_fqn", fqn_from_path(path_col))
    j = f.join(cls, "_fqn", "left")
    d = F.regexp_replace(F.col(path_col), "[^/]*$", "")
    return j.withColumn("new_path", F.when(F.col("_new").isNull(), F.col(path_col))
                        .otherwise(F.concat(d, F.col("_new"), F.lit(".java")))).drop("_fqn", "_new")


def top_types(decls: DataFrame) -> DataFrame:
    """The type a file is named after (``file``, ``class_name``, ``fqn``): its first public class or interface, or its only type."""
    tops = decls.filter((F.col("unit_kind") == "type") & (F.col("outer") == ""))
    public = F.col("header").rlike("(^|\\s)public\\s") & F.col("type_kind").isin("class", "interface")
    per = tops.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("pkg", "class_name"), F.when(public, F.col("ordinal"))).alias("p"),
                                   F.first(F.struct("pkg", "class_name", "type_kind")).alias("only"))
    one = F.coalesce(F.col("p"), F.when((F.col("n") == 1) & F.col("only.type_kind").isin("class", "interface"),
                                        F.struct(F.col("only.pkg").alias("pkg"), F.col("only.class_name").alias("class_name"))))
    per = per.select("file", one.alias("t")).filter("t is not null")
    return per.select("file", F.col("t.class_name").alias("class_name"), class_fqn("t.pkg", "t.class_name").alias("fqn"))


def rename_files_for_types(files: DataFrame, decls: DataFrame, mapping: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """Add ``new_path``; a file whose top type is renamed gets the type's new simple name.

    Two files that would get one path are settled by the ranking of folder names (W6): in path order ``Name``, ``Name2``, ...,
    never a name that a file which stays already has.  Paths only are ranked; the result is looked up in the row."""
    from legible.operators.folders import leaf_of, parent_of, resolve_name_conflicts
    rules = first_rules(mapping.filter(F.col("kind") == "class"), F.col("old_key"), F.substring_index("new_name", ".", -1))
    named = top_types(decls).join(rules.withColumnRenamed("old_key", "fqn"), "fqn").filter("class_name <> new_name")
    ext = F.regexp_extract("folder", "\\.[^./]*$", 0)
    cands = cut_lineage(named.select(F.col("file").alias("folder"), parent_of("file").alias("parent"), F.col("new_name").alias("segment")))
    stay = files.select(F.col(path_col).alias("folder")).distinct().join(cands.select("folder"), "folder", "left_anti")
    stay = stay.select("folder", parent_of("folder").alias("parent"), F.regexp_replace(leaf_of("folder"), "\\.[^.]*$", "").alias("name"))
    plan = resolve_name_conflicts(cands, cut_lineage(stay)).select("folder", F.concat("new_folder", ext).alias("path"))
    out = with_map(files, F.array(path_col), cut_lineage(plan), "_to", "folder", "path")
    return out.withColumn("new_path", F.coalesce(at(F.col("_to"), F.coalesce(F.col(path_col), F.lit(""))), F.col(path_col))).drop("_to")


# A14
def doc_spans(items, indent=None) -> Column:
    """Items (start, end, block[, indent]) -> splice spans: the block, a line break and the target's indentation."""
    def one(x):
        pad = F.coalesce(x["indent"], F.lit("")) if indent else F.lit("")
        new = F.concat(F.replace(x["block"], F.lit("\n"), F.concat(F.lit("\n"), pad)), F.lit("\n"), pad)
        return F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), new.alias("new"))
    return F.array_sort(F.transform(_c(items), one))


def attach_docs_in_row(files: DataFrame, items: Column, text_col: str = "text", indent: bool = False) -> DataFrame:
    """Doc blocks whose items (array of start, end, block[, indent]) were found in the row itself: add ``new_text``, ``n_docs``."""
    out = files.withColumn("_spans", doc_spans(items, indent))
    return out.select(*files.columns, F.when(F.coalesce(F.size("_spans"), F.lit(0)) <= 0, F.col(text_col)).otherwise(splice(text_col, "_spans")).alias("new_text"),
                      F.greatest(F.coalesce(F.size("_spans"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_docs"))


def attach_docs(files: DataFrame, doc_items: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insert doc blocks before their targets.  ``doc_items``: (key, start, end, block[, indent]) where
    [start, end) is the span of an existing block to overwrite (start = end to insert); with an
    ``indent`` column every block line after the first and the target line keep that indentation."""
    indent = ["indent"] if "indent" in doc_items.columns else []
    per_file = doc_items.groupBy(key).agg(F.collect_list(F.struct("start", "end", "block", *indent)).alias("_items"))
    j = files.join(per_file, key, "left")
    return attach_docs_in_row(j, F.col("_items"), text_col, bool(indent)).drop("_items")
