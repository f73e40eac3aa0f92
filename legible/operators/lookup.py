"""Side tables as lookups inside the row, chosen behind a measured size.

A rule table whose rows and characters are *measured* below a bound becomes one constant: an array of small maps,
indexed by the key's checksum, so a lookup reads a handful of entries however many rules there are.  Texts are then
rewritten where they are: nothing of them is shuffled, sorted or joined.

A larger table is first reduced to the keys that occur, with their numbers of rows (partial aggregates, so a frequent
key collapses before the shuffle).  If that is still above the bound, the most frequent keys become the constant, as many
as it holds, and only the rest is joined: none of its keys can be frequent, most rows ask for few of them, and texts move
once, with their rules.  All ways give the same rules; only the plan differs.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legible.functions.text import let
from legible.session import cut_lineage

# the constant stands in the plan several times, and the driver keeps and prints plans: 20,000 rules are a few MB there,
# while 100,000 ended a driver with 750 MB of heap
LOOKUP_MAX_ROWS = 20_000        # rules in one constant
LOOKUP_MAX_CHARS = 1 << 20      # characters of keys and values in one constant
KEY_CHARS = 1000                # a rule with a longer key or value is never part of a constant
ENTRIES_PER_BUCKET = 4


class Lookup:
    """A constant map from string to ``kind`` (a Spark type name) that a Column expression can read."""

    def __init__(self, pairs: dict, kind: str = "string"):
        self.n = max(1, len(pairs) // ENTRIES_PER_BUCKET)
        self.kind, self.empty = kind, not pairs
        buckets: list[dict] = [{} for _ in range(self.n)]
        for k, v in pairs.items():
            buckets[zlib.crc32(k.encode()) % self.n][k] = v
        self.buckets = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,%s>>" % kind)

    def __call__(self, key: Column) -> Column:
        """The value of ``key``; null where there is none."""
        if self.empty:
            return F.lit(None).cast(self.kind)
        return F.get(self.buckets, F.pmod(F.crc32(key.cast("binary")), F.lit(self.n)).cast("int"))[key]


def _plain(v):
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def measured_lookup(rules: DataFrame, key: str = "old_key", value: str = "new_name") -> Lookup | None:
    """The lookup of a table with one row per key; None if it measures above the bound.

    One job: at most one row beyond the bound is fetched, and an overlong rule as a mark in its place."""
    long = (F.length(key) > KEY_CHARS) | (F.length(F.to_json(F.struct(F.col(value)))) > KEY_CHARS)
    cut = rules.filter(F.col(key).isNotNull()).select(F.when(~long, F.col(key)).alias("k"), F.when(~long, F.col(value)).alias("v"), long.alias("long"))
    rows = cut.limit(LOOKUP_MAX_ROWS + 1).collect()
    pairs = {r["k"]: _plain(r["v"]) for r in rows if not r["long"]}
    if len(pairs) < len(rows) or len(rows) > LOOKUP_MAX_ROWS or sum(len(k) + len(json.dumps(v)) for k, v in pairs.items()) > LOOKUP_MAX_CHARS:
        return None
    return Lookup(pairs, rules.schema[value].dataType.simpleString())


def bucketed(entries: Column) -> Column:
    """Array of (k, v) with distinct keys -> array of small maps by the key's checksum, about the root of their number, so
    neither building nor reading a row's rules goes over all of them each time.  No entries: an empty array."""
    def spread(es: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(es))).cast("long")
        buckets = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda b: F.map_from_entries(F.transform(
            F.filter(es, lambda e: F.pmod(e["h"], n) == b), lambda e: F.struct(e["k"], e["v"]))))
        return F.when(F.size(es) > 0, buckets).otherwise(F.slice(buckets, 1, 0))
    hashed = F.transform(entries, lambda e: F.struct(F.crc32(e["k"].cast("binary")).alias("h"), e["k"].alias("k"), e["v"].alias("v")))
    return F.when(F.size(entries) > 0, let(hashed, spread))


def at(rules: Column, key: Column) -> Column:
    """The rule of ``key`` in a row's bucketed rules; null where there is none."""
    return F.when(F.size(rules) > 0, F.get(rules, F.pmod(F.crc32(key.cast("binary")), F.greatest(F.size(rules), F.lit(1))).cast("int"))[key])


def no_rules(kind: str = "string") -> Column:
    return F.array().cast("array<map<string,%s>>" % kind)


def with_map(files: DataFrame, keys: Column, rules: DataFrame, out: str, key: str = "old_key", value: str = "new_name") -> DataFrame:
    """Add ``out``: those of a row's ``keys`` (array of strings) that have a rule, with the rule's value, ``bucketed``; read
    it with ``at``.

    ``rules`` has one row per key and is read several times: pass a written table."""
    kind = rules.schema[value].dataType.simpleString()
    keys = F.array_distinct(F.coalesce(keys, F.array().cast("array<string>")))

    def hits(found):
        return F.filter(F.transform(keys, lambda k: F.struct(k.alias("k"), found(k).alias("v"))), lambda e: e["v"].isNotNull())

    found = measured_lookup(rules, key, value)
    if found is None:
        used = files.select(F.explode(keys).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
        rules = cut_lineage(rules.join(used, key))
        found = measured_lookup(rules, key, value)
    if found is not None:
        return files.withColumn(out, no_rules(kind) if found.empty else F.coalesce(let(hits(found), bucketed), no_rules(kind)))
    found = frequent_lookup(rules, key, value)
    # rows that ask for the same keys share their rules; they are brought together by a checksum, where others may meet
    # them: a row with more rules than it asked for reads the same values
    rare = F.filter(keys, lambda k: found(k).isNull())
    ident = F.when(F.size(rare) > 0, F.xxhash64(rare))
    asked = files.select(ident.alias("_of"), rare.alias("_ks")).filter("_of is not null").groupBy("_of").agg(
        F.array_distinct(F.flatten(F.collect_set("_ks"))).alias("_ks"))
    asked = asked.select("_of", F.explode("_ks").alias(key))
    rest = rules.filter(found(F.col(key)).isNull()).select(key, F.col(value).alias("_v"))
    given = asked.join(rest, key).groupBy("_of").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_v").alias("v"))).alias("_es"))
    joined = files.withColumn("_of", ident).join(given, "_of", "left")
    both = F.concat(hits(found), F.coalesce("_es", F.array().cast("array<struct<k:string,v:%s>>" % kind)))
    return joined.withColumn(out, F.coalesce(let(both, bucketed), no_rules(kind))).drop("_of", "_es")


def frequent_lookup(rules: DataFrame, key: str, value: str) -> Lookup:
    """The lookup of the most frequent keys (by ``_rows``), as many as the bounds allow.

    A histogram of the frequencies (at most 1,024 classes) says which classes fit whole; of the first one that does not, keys
    are taken by their hash.  So about ``LOOKUP_MAX_ROWS`` rows reach the driver, however many keys and partitions there are
    (a sort with a limit would send that many from every partition)."""
    small = (F.length(key) <= KEY_CHARS) & (F.length(F.to_json(F.struct(F.col(value)))) <= KEY_CHARS)
    classed = rules.filter(small).withColumn("_class", F.floor(F.log2("_rows") * 16).cast("int"))
    sizes = {r["_class"]: r["count"] for r in classed.groupBy("_class").count().collect()}
    whole, left = max(sizes, default=0) + 1, LOOKUP_MAX_ROWS
    while whole > 0 and sizes.get(whole - 1, 0) <= left:
        whole, left = whole - 1, left - sizes.get(whole - 1, 0)
    part = F.pmod(F.xxhash64(key), F.lit(max(1, sizes.get(whole - 1, 1)))) < left
    top = classed.filter((F.col("_class") >= whole) | ((F.col("_class") == whole - 1) & part)).select(key, value, "_rows").collect()
    pairs, rows, chars = {}, LOOKUP_MAX_ROWS, LOOKUP_MAX_CHARS
    for k, v, _ in sorted(top, key=lambda r: (-r[2], r[0])):
        v = _plain(v)
        rows, chars = rows - 1, chars - len(k) - len(json.dumps(v))
        if rows < 0 or chars < 0:
            break
        pairs[k] = v
    return Lookup(pairs, rules.schema[value].dataType.simpleString())
