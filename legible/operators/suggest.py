"""Token statistics and rename-mapping resolution.

Unit table columns used here (see ``legible.schemas.UNIT``): ``unit_order`` (a total order of
units, the reference's list order), ``pkg``, ``class_name``, ``class_fqn``, ``method_name``,
``param_types``, ``qualified_signature``, ``decl``, ``code``, ``unit_kind``.

Suggestion table: ``batch_id, pos, kind, old, new``.  Mapping table (long form):
``kind ('simple'|'class'|'field'|'method'), old_key, new_name, prio``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legible.session import cut_lineage


# ---- fixed values that must equal the reference's behaviour ---------------------------------
# Rename pool of the offline heuristic, in rank order.
NAME_POOL = ["value", "tmp", "i", "j", "k", "idx", "count", "flag",
             "size", "buf", "item", "data", "map", "list", "user", "token"]
# Pool used to fill a mapping that came back without any short-name rule.
FILL_POOL = ["value", "sum", "count", "idx", "base", "data", "item"]
TOP_TOKENS = 32
SHORT_ID = "[a-z]{1,2}[0-9]?"
SUGGESTION_KINDS = ["class", "method", "field", "var"]
# ----------------------------------------------------------------------------------------------

# Java language keywords and literals: excluded from rename keys by default (our Q7 decision).
RESERVED_WORDS = sorted("""abstract assert boolean break byte case catch char class const continue default do double
else enum extends final finally float for goto if implements import instanceof int interface long native new
package private protected public return short static strictfp super switch synchronized this throw throws
transient try void volatile while true false null var record yield sealed permits""".split())

# ASCII identifier runs, as the heuristic tokeniser splits declarations on [^A-Za-z0-9_].
_ASCII_RUN = "[A-Za-z0-9_]"
# Word characters as a JVM-17 word boundary sees them (letters and digits of any script).
_UNI_WORD = "[\\p{L}\\p{Nd}_]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _prio(units: DataFrame, agg_col: str) -> Column:
    """Numeric rule priority from the unit order when it is numeric (struct orders give null)."""
    numeric = dict(units.dtypes).get("unit_order") in ("bigint", "int")
    return F.col(agg_col).cast("bigint") if numeric else F.lit(None).cast("bigint")


def short_tokens(text) -> Column:
    """All ``[a-z]{1,2}[0-9]?`` tokens that are whole ASCII identifier runs (G1 tokeniser)."""
    pat = "(?<!%s)%s(?!%s)" % (_ASCII_RUN, SHORT_ID, _ASCII_RUN)
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(pat), 0)


def short_idents_unicode(text) -> Column:
    """Short identifiers between word boundaries where any letter counts as a word char."""
    pat = "(?<!%s)(%s)(?!%s)" % (_UNI_WORD, SHORT_ID, _UNI_WORD)
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(pat), 1)


# G1
def short_token_counts(df: DataFrame, text_col: str = "decl") -> DataFrame:
    """Count short identifiers; partial aggregation collapses hot tokens before the shuffle."""
    return (df.select(F.explode(short_tokens(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")))


# W2
def top_tokens(counts: DataFrame, k: int = TOP_TOKENS) -> DataFrame:
    """Top-k by count, ties by token ascending (Q5); planned as TakeOrderedAndProject."""
    top = counts.orderBy(F.desc("cnt"), F.asc("token")).limit(k)
    # at most k rows reach this single-partition window
    return top.withColumn("rnk", (F.row_number().over(Window.orderBy(F.desc("cnt"), F.asc("token"))) - 1)
                          .cast("bigint"))


def pool_name(rank: Column, pool: list[str]) -> Column:
    n = len(pool)
    base = F.element_at(F.array(*[F.lit(p) for p in pool]), (rank % n + 1).cast("int"))
    cycle = F.floor(rank / n).cast("bigint")
    return F.concat(base, F.when(cycle == 0, F.lit("")).otherwise(cycle.cast("string")))


# W3
def pool_names(top: DataFrame, pool: list[str] = NAME_POOL) -> DataFrame:
    """Rank i -> pool[i % 16] + (i // 16 or ''); identity skipped, rank still consumed."""
    named = top.withColumn("new_name", pool_name(F.col("rnk"), pool))
    return named.filter(F.col("token") != F.col("new_name")).select("token", "new_name", "rnk")


# F5
def short_zero_arg_methods(units: DataFrame, parity: bool = False) -> DataFrame:
    cond = (F.length(F.coalesce("method_name", F.lit("x" * 3))) <= 2) & \
           (F.coalesce(F.size("param_types"), F.lit(0)) <= 0)
    if not parity:  # Q18: only real methods, not class-level units or constructors
        cond = cond & (F.col("unit_kind") == "method")
    return units.filter(cond)


# I9
def heuristic_names(units: DataFrame, parity: bool = False) -> DataFrame:
    """Offline provider: pool names for the top short tokens of declarations, plus ``get<Class>``
    for short zero-arg methods (first unit wins per signature)."""
    simple = pool_names(top_tokens(short_token_counts(units, "decl"))).select(
        F.lit("simple").alias("kind"), F.col("token").alias("old_key"), "new_name",
        F.col("rnk").alias("prio"))
    meth = (short_zero_arg_methods(units, parity)
            .filter(F.col("qualified_signature").isNotNull())
            .groupBy(F.col("qualified_signature").alias("old_key"))
            .agg(F.min_by(F.concat(F.lit("get"), F.coalesce("class_name", F.lit("Value"))),
                          F.col("unit_order")).alias("new_name"),
                 F.min("unit_order").alias("_first"))
            .select(F.lit("method").alias("kind"), "old_key", "new_name", _prio(units, "_first").alias("prio")))
    return simple.unionByName(meth)


# F1
def valid_suggestions(sugg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split suggestions into (valid, rejected); blank = whitespace only, null kind rejected."""
    ok = (F.col("kind").isNotNull() & F.col("kind").isin(*SUGGESTION_KINDS) & F.col("old").isNotNull()
          & F.col("new").isNotNull() & (F.regexp_replace("new", "\\s+", "") != ""))
    return sugg.filter(ok), sugg.filter(~F.coalesce(ok, F.lit(False)))


def _first_per(df: DataFrame, key: str, value: Column) -> DataFrame:
    """W1 first-wins: earliest ``(batch_id, pos)`` per key, via a partial-aggregating min_by."""
    order = F.struct("batch_id", "pos")
    return df.groupBy(key).agg(F.min_by(value, order).alias("new_name"), F.min(order).alias("_o"))


# J1
def _class_keys(units: DataFrame | None, keys: DataFrame | None) -> DataFrame:
    if keys is not None:
        return keys.filter(F.col("kind") == "class").select(F.col("name").alias("class_name"), F.col("key").alias("class_fqn"))
    return units.filter(F.col("class_fqn").isNotNull()).select("class_name", "class_fqn").distinct()


def _method_keys(units: DataFrame | None, keys: DataFrame | None) -> DataFrame:
    if keys is not None:
        return keys.filter(F.col("kind") == "method").select(F.col("name").alias("method_name"),
                                                            F.col("key").alias("qualified_signature"))
    return units.filter(F.col("qualified_signature").isNotNull()).select("method_name", "qualified_signature").distinct()


def resolve_class_suggestions(sugg: DataFrame, units: DataFrame | None, keys: DataFrame | None = None) -> DataFrame:
    """class suggestion old=className fans out to every unit of that class -> (classFqn, pkg.new).

    Suggestions are reduced to the first one per old name before the join, so every key meets at
    most one suggestion; the key side is already distinct (``allowed_keys``)."""
    valid, _ = valid_suggestions(sugg)
    first = _first_per(valid.filter(F.col("kind") == "class"), "old", F.col("new"))
    first = first.select(F.col("old").alias("class_name"), "new_name", "_o")
    u = _class_keys(units, keys)
    j = u.join(first, "class_name")
    pkg = F.regexp_replace("class_fqn", "\\.?[^.]*$", "")
    new_fqn = F.when(pkg == "", F.col("new_name")).otherwise(F.concat(pkg, F.lit("."), F.col("new_name")))
    return (j.groupBy(F.col("class_fqn").alias("old_key"))
             .agg(F.min_by(new_fqn, F.col("_o")).alias("new_name"), F.min("_o").alias("_o")))


# J2
def resolve_method_suggestions(sugg: DataFrame, units: DataFrame | None, keys: DataFrame | None = None) -> DataFrame:
    valid, _ = valid_suggestions(sugg)
    first = _first_per(valid.filter(F.col("kind") == "method"), "old", F.col("new"))
    first = first.select(F.col("old").alias("method_name"), "new_name", "_o")
    u = _method_keys(units, keys)
    return (u.join(first, "method_name")
             .groupBy(F.col("qualified_signature").alias("old_key"))
             .agg(F.min_by("new_name", F.col("_o")).alias("new_name"), F.min("_o").alias("_o")))


# J3
def resolve_simple_suggestions(sugg: DataFrame) -> DataFrame:
    valid, _ = valid_suggestions(sugg)
    return _first_per(valid.filter(F.col("kind").isin("field", "var")), "old", F.col("new")) \
        .withColumnRenamed("old", "old_key")


def suggestions_to_mapping(sugg: DataFrame, units: DataFrame | None, keys: DataFrame | None = None) -> DataFrame:
    """J1-J3 + W1 to the long mapping table; ``prio`` keeps the winning suggestion's order."""
    def fin(df, kind):
        return df.select(F.lit(kind).alias("kind"), "old_key", "new_name",
                         (F.col("_o.batch_id") * F.lit(1 << 20) + F.col("_o.pos")).cast("bigint").alias("prio"))
    return (fin(resolve_class_suggestions(sugg, units, keys), "class")
            .unionByName(fin(resolve_method_suggestions(sugg, units, keys), "method"))
            .unionByName(fin(resolve_simple_suggestions(sugg), "simple")))


# G2 / U2
def allowed_keys(units: DataFrame) -> DataFrame:
    """Distinct class, method and short-identifier keys with their first-seen order, in ONE pass.

    Returns ``kind ('class'|'method'|'simple'), key, name, first_order`` where ``name`` is the
    class / method simple name of the key (null for simple keys) and ``first_order`` is a struct
    (unit_order, part, position) that reproduces insertion order of the reference's sets.  Every
    unit emits its keys as an array that is exploded and partially aggregated per key, so hot keys
    collapse map-side and the units table is read once."""
    def entry(kind, key, name, part, p):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), name.alias("name"),
                        F.lit(part).alias("part"), p.cast("int").alias("p"))
    none = F.lit(None).cast("string")
    fixed = F.array(entry("class", F.col("class_fqn"), F.col("class_name"), 0, F.lit(0)),
                    entry("method", F.col("qualified_signature"), F.col("method_name"), 0, F.lit(0)))
    decl = F.transform(short_idents_unicode("decl"), lambda x, i: entry("simple", x, none, 0, i))
    code = F.transform(short_idents_unicode("code"), lambda x, i: entry("simple", x, none, 1, i))
    e = units.select("unit_order", F.explode(F.concat(fixed, decl, code)).alias("e")).filter(F.col("e.key").isNotNull())
    return (e.groupBy(F.col("e.kind").alias("kind"), F.col("e.key").alias("key"))
             .agg(F.min(F.struct(F.col("unit_order"), F.col("e.part").alias("part"), F.col("e.p").alias("p")))
                  .alias("first_order"), F.first("e.name", ignorenulls=True).alias("name"))
             .select("kind", "key", "name", "first_order"))


def _blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, "\\s+", "") == "", F.lit(True))


# J4
def restrict_to_allowed(mapping: DataFrame, allowed: DataFrame, exclude_reserved: bool = True) -> DataFrame:
    """Keep class/method/simple keys only if allowed; field keys need '#'; blank or identity dropped."""
    keyed = mapping.filter(~_blank(F.col("new_name")))
    a = allowed.select(F.col("kind").alias("_k"), F.col("key").alias("old_key"))
    in_set = (keyed.filter(F.col("kind").isin("class", "method", "simple"))
                   .withColumn("_k", F.col("kind"))
                   .join(a, ["_k", "old_key"], "left_semi").drop("_k"))
    in_set = in_set.filter((F.col("kind") != "simple") | (F.col("old_key") != F.col("new_name")))
    fields = keyed.filter((F.col("kind") == "field") & F.col("old_key").contains("#"))
    out = in_set.unionByName(fields)
    if exclude_reserved:
        out = out.filter(~((F.col("kind") == "simple") & F.col("old_key").isin(*RESERVED_WORDS)))
    return out


def method_guess(code) -> Column:
    c = F.coalesce(_c(code), F.lit(""))
    return (F.when(c.contains("+"), F.lit("add")).when(c.contains("get"), F.lit("get"))
             .when(c.contains("put"), F.lit("put")).otherwise(F.lit("process")))


# U4
def fallback_fill(mapping: DataFrame, units: DataFrame, allowed: DataFrame, exclude_reserved: bool = True,
                  parity: bool = False) -> DataFrame:
    """Add guessed method rules when none survived and pool names for the first 7 short keys
    when no simple rule survived.  The emptiness tests are bounded probes (``limit(1)``)."""
    mapping = cut_lineage(mapping)              # written before it is probed: the probes and the result read one table
    out = mapping.withColumn("source", F.lit("model"))
    has_method = len(mapping.filter(F.col("kind") == "method").limit(1).collect()) > 0
    has_simple = len(mapping.filter(F.col("kind") == "simple").limit(1).collect()) > 0
    if not has_method:
        targets = units if parity else units.filter(F.col("unit_kind") == "method")   # Q18: no ctors / types
        guess = (targets.filter(F.col("qualified_signature").isNotNull())
                 .groupBy(F.col("qualified_signature").alias("old_key"))
                 .agg(F.min_by(method_guess("code"), F.col("unit_order")).alias("new_name"),
                      F.min("unit_order").alias("_first"))
                 .select(F.lit("method").alias("kind"), "old_key", "new_name", _prio(units, "_first").alias("prio"),
                         F.lit("fallback").alias("source")))
        out = out.unionByName(guess)
    if not has_simple:
        simple = allowed.filter(F.col("kind") == "simple")
        if exclude_reserved:
            simple = simple.filter(~F.col("key").isin(*RESERVED_WORDS))
        first = (simple.orderBy("first_order").limit(len(FILL_POOL))
                 .withColumn("prio", (F.row_number().over(Window.orderBy("first_order")) - 1).cast("bigint")))
        fill = (first.withColumn("new_name", F.element_at(F.array(*[F.lit(p) for p in FILL_POOL]),
                                                          (F.col("prio") + 1).cast("int")))
                .filter(F.col("key") != F.col("new_name"))
                .select(F.lit("simple").alias("kind"), F.col("key").alias("old_key"), "new_name", "prio",
                        F.lit("fallback").alias("source")))
        out = out.unionByName(fill)
    return out


# G3
def mapping_sizes(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rules"))


# F2
def effective_rules(mapping: DataFrame) -> DataFrame:
    """Drop no-op and blank rules, and method/field rules without an owner."""
    ok = ~_blank(F.col("new_name")) & F.col("old_key").isNotNull() & (F.col("old_key") != F.col("new_name"))
    owner_ok = ~F.col("kind").isin("method", "field") | F.col("old_key").rlike("^[^#(]*[#.][^#.(]+(\\(.*\\))?$")
    return mapping.filter(ok & owner_ok)
