"""One-pass rewriting: every rule becomes spans on the original text, spliced once (L3 with A1-A5, A8).

A text is read from left to right as import lines, identifiers (with the bracket of a call) and what lies between.
Every stretch gets at most one replacement, decided on the original text by priority: import line, class, method (in
its owner's file, before a bracket), field (in its owner's file), short name.  So rules never feed each other: chains
and swaps come out right within a kind and between kinds.  Everything outside the replaced stretches stays as it was,
line ends included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legible.functions.text import IDENT_CLASS, fqn_from_path
from legible.operators.lookup import at, bucketed, let, measured_lookup, no_rules, with_map

WS = "[ \\t\\n\\x0B\\f\\r]"
IMPORT_START = "[ \\t]*import[ \\t]+"
IMPORTED = "[A-Za-z_$][%s]*(?:\\.[%s]+)*" % (IDENT_CLASS, IDENT_CLASS)
WHOLE_IMPORT = "(?:\\A|(?<=\\n))%s(%s)[ \\t]*;[ \\t]*(?=\\r?(?:\\n|\\z))" % (IMPORT_START, IMPORTED)
IDENT = "[%s]+" % IDENT_CLASS
STRETCH = "|".join((WHOLE_IMPORT, IDENT + "(?:" + WS + "*\\()?", "[^%s\\n]*+\\n" % IDENT_CLASS, "[^%s\\n]++" % IDENT_CLASS))
TOKEN = "%s|[^%s]+" % (IDENT, IDENT_CLASS)
KINDS = ("import", "class", "method", "field", "simple")


def first_rules(rules: DataFrame, key: Column, new: Column) -> DataFrame:
    """One row per key (``old_key``, ``new_name``): the first by ``prio``, then by new name."""
    order = [F.col("prio")] if "prio" in rules.columns else []
    return (rules.select(key.alias("_k"), new.alias("_n"), *order).filter("_k is not null and _n is not null")
            .groupBy(F.col("_k").alias("old_key")).agg(F.min_by("_n", F.struct(*order, F.col("_n"))).alias("new_name")))


def owner_members(mapping: DataFrame) -> DataFrame:
    """``owner, old_name, new_name, call, prio`` of method keys (``owner#m(..)`` or ``owner.m(T,..)``) and field keys (``owner#f``)."""
    key = F.col("old_key")
    has_hash = F.instr(key, "#") > 0
    head = F.regexp_replace(key, "\\(.*$", "")
    owner = F.when(has_hash, F.substring_index(key, "#", 1)).otherwise(F.regexp_replace(head, "\\.[^.]*$", ""))
    name = F.when(has_hash, F.regexp_replace(F.substring_index(key, "#", -1), "\\(.*$", "")).otherwise(F.substring_index(head, ".", -1))
    return (mapping.filter(F.col("kind").isin("method", "field") & F.col("new_name").isNotNull())
            .select(owner.alias("owner"), F.trim(name).alias("old_name"), "new_name", (F.col("kind") == "method").alias("call"), "prio")
            .filter((F.col("owner") != "") & (F.col("old_name") != "")))


def _owned(mapping: DataFrame) -> DataFrame:
    """One row per owner: its method and its field names with their new ones, bucketed; the first rule of a name holds."""
    first = (owner_members(mapping).groupBy("owner", "call", "old_name")
             .agg(F.min_by("new_name", F.struct("prio", "new_name")).alias("new")))

    def of(call: bool) -> Column:
        return bucketed(F.collect_list(F.when(F.col("call") == call, F.struct(F.col("old_name").alias("k"), F.col("new").alias("v")))))
    return first.groupBy("owner").agg(F.struct(of(True).alias("m"), of(False).alias("f")).alias("members"))


def import_names(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WHOLE_IMPORT), 1)


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENT), 0))


def _replaced(text: Column, m: Column) -> Column:
    """(new text, kind of every hit) by the row's maps ``m`` (fields import, class, method, field, simple)."""
    def hit(ident: Column, call: Column) -> Column:
        found = [("class", at(m["class"], ident)), ("method", F.when(call, at(m["method"], ident))),
                 ("field", at(m["field"], ident)), ("simple", at(m["simple"], ident))]
        new = F.coalesce(*[v for _, v in found])
        kind = F.lit(None).cast("string")
        for name, v in reversed(found):
            kind = F.when(v.isNotNull(), F.lit(name)).otherwise(kind)
        return F.struct(new.alias("new"), kind.alias("kind"))

    def plain(tok: Column) -> Column:                       # inside an import line that is not renamed as a whole
        return let(hit(tok, F.lit(False)), lambda h: F.struct(F.coalesce(h["new"], tok).alias("o"), h["kind"].alias("k")))

    def import_line(s: Column) -> Column:
        new = at(m["import"], F.regexp_extract(s, "^%s(%s)" % (IMPORT_START, IMPORTED), 1))
        parts = F.transform(F.regexp_extract_all(s, F.lit(TOKEN), 0), plain)
        whole = F.array(F.struct(F.concat(F.lit("import "), new, F.lit(";")).alias("o"), F.lit("import").alias("k")))
        return F.when(new.isNotNull(), whole).otherwise(parts)

    def other(s: Column) -> Column:
        call = F.endswith(s, F.lit("("))
        ident = F.when(call, F.regexp_replace(s, WS + "*\\($", "")).otherwise(s)
        return let(F.struct(ident.alias("i"), call.alias("c")), lambda z: let(hit(z["i"], z["c"]), lambda h: F.array(F.struct(
            F.when(h["kind"].isNull(), s).when(h["kind"] == "method", F.concat(h["new"], F.lit("(")))
             .otherwise(F.concat(h["new"], F.substr(s, F.length(z["i"]) + 1))).alias("o"), h["kind"].alias("k")))))

    def stretch(s: Column) -> Column:
        return F.when(F.contains(s, F.lit(";")) & F.contains(s, F.lit("import")), import_line(s)).otherwise(other(s))

    pieces = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(STRETCH), 0), stretch))
    return let(pieces, lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: p["o"]), "").alias("t"),
                                           F.filter(F.transform(ps, lambda p: p["k"]), lambda k: k.isNotNull()).alias("ks")))


def apply_spans(files: DataFrame, mapping: DataFrame, path_col: str = "rel_path", text_col: str = "text",
                owner_col: Column | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Add ``new_text``, ``n_replacements`` and ``hits`` (a struct of counts by kind) to ``files``.

    ``mapping``: (kind, old_key, new_name, prio), a written table (it is read several times).  A null text stays null.
    Rows need no key; repeated rows are each rewritten."""
    kept, none = files.columns, no_rules()
    classes = mapping.filter(F.col("kind") == "class")
    last = [F.substring_index(c, ".", -1) for c in ("old_key", "new_name")]
    ident = F.col("old_key").rlike("^[%s]+$" % IDENT_CLASS)
    out, tokens = files, identifiers(F.col(text_col))
    sources = {"import": (first_rules(classes, F.col("old_key"), F.col("new_name")), import_names(F.col(text_col))),
               "class": (first_rules(classes, *last).filter(ident), tokens),
               "simple": (first_rules(mapping.filter(F.col("kind") == "simple"), F.col("old_key"), F.col("new_name")).filter(ident), tokens)}
    for kind in KINDS:
        if kind in sources:
            out = with_map(out, sources[kind][1], sources[kind][0], "_" + kind) if kind in kinds else out.withColumn("_" + kind, none)
    if "method" in kinds or "field" in kinds:
        out = out.withColumn("_owner", owner_col if owner_col is not None else fqn_from_path(path_col))
        owned = _owned(mapping.filter(F.col("kind").isin(*kinds)))
        found = measured_lookup(owned, "owner", "members")
        if found is not None:
            out = out.withColumn("_own", found(F.col("_owner")))
        else:                                               # a file has one owner, so the key is no hot one
            out = out.join(owned.select(F.col("owner").alias("_owner"), F.col("members").alias("_own")), "_owner", "left")
        out = out.withColumn("_method", F.coalesce("_own.m", none)).withColumn("_field", F.coalesce("_own.f", none))
    else:
        out = out.withColumn("_method", none).withColumn("_field", none)
    maps = F.struct(*[F.col("_" + k).alias(k) for k in KINDS])
    idle = F.aggregate(F.array(*[F.size("_" + k) for k in KINDS]), F.lit(0), lambda a, x: a + x) == 0
    same = F.struct(F.col(text_col).alias("t"), F.array().cast("array<string>").alias("ks"))
    done = F.when(F.col(text_col).isNull() | idle, same).otherwise(let(maps, lambda m: _replaced(F.col(text_col), m)))
    out = out.withColumn("_done", done)

    def count(kind: str) -> Column:
        return F.size(F.filter("_done.ks", lambda k: k == F.lit(kind))).cast("bigint").alias(kind)
    counts = F.struct(*[count(kind) for kind in KINDS])
    return out.select(*kept, F.col("_done.t").alias("new_text"), F.size("_done.ks").cast("bigint").alias("n_replacements"),
                      counts.alias("hits"))
