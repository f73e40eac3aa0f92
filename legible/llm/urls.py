"""URL filter: fixed rules first, else empirical-Bayes host reputation.

*Rules.*  A rule is a host, a path and a verdict; it fits its host and all subdomains where the url's path starts
with the rule's.  The longest fitting rule wins.

*Reputation.*  Labelled pages are good or bad outcomes of their host.  A host's bad rate has a beta prior
centred on its registered domain's posterior, the domain's on its suffix's, the suffix's on the corpus rate;
each level's prior strength is estimated from how much its members' rates spread beyond binomial noise (method of
moments).  A host is blocked when the lower bound (mean - z standard deviations) of its posterior bad rate is
above ``limit``: few labels cannot block a host, many bad ones do.

Scale: outcomes are summed per host before anything is joined; each level is an aggregate of the one below;
a crowded host is a skew-split join key.  Three sums per level reach the driver.

Edge cases: a null url or one without ``://`` has empty host and path, fits no rule and is judged by the corpus
rate alone, like a host without labels; several labels of a page count as one outcome (bad if any is); null labels
are no outcome; empty tables on either side work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legible.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of a level's prior strength (in labelled pages).
WEAKEST, STRONGEST = 1.0, 1000.0
#: Public suffixes of several labels (the common ones); hosts below any other suffix are cut at their last label.
SUFFIXES = tuple(f"{a}.{c}" for c, kinds in {
    "uk": "co org ac gov net me ltd plc sch nhs", "au": "com net org edu gov id asn", "nz": "co net org ac govt school",
    "jp": "co ne or ac go ad ed gr lg", "kr": "co ne or ac go re", "br": "com net org gov edu", "ar": "com net org gob edu",
    "mx": "com net org gob edu", "cn": "com net org gov edu ac", "tw": "com net org gov edu", "hk": "com net org gov edu",
    "sg": "com net org gov edu", "my": "com net org gov edu", "in": "co net org gov ac edu firm gen ind", "id": "co net or go ac",
    "th": "co in or go ac", "tr": "com net org gov edu", "za": "co net org gov ac", "il": "co net org gov ac", "ua": "com net org gov edu"}.items()
    for a in kinds.split())


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], value: int) -> Column:
    """The rule string (``value`` 0) or verdict (1) of the longest fitting rule; null if none fits.
    ``rules``: (host, path, verdict), a short list."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(verdict if value else h + p)).otherwise(out)
    return out


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Public suffix: the longest listed one, else the last label."""
    out = F.substring_index(host, ".", -1)
    for s in sorted(suffixes, key=lambda s: (s.count("."), s)):
        out = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(out)
    return out


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Registered domain: the public suffix and the label before it (the host itself if it has none)."""
    out = F.substring_index(host, ".", -2)
    for s in sorted(suffixes, key=lambda s: (s.count("."), s)):
        out = F.when((host == s) | host.endswith("." + s), F.substring_index(host, ".", -(s.count(".") + 2))).otherwise(out)
    return out


def _strength(children: DataFrame) -> float:
    """Prior strength from rows ``k, n, centre`` (bad, all, parent's rate): the intra-class correlation rho of the
    beta-binomial by moments, strength = 1 / rho - 1."""
    r = children.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("centre"), 2)).alias("spread"),
        F.avg(F.col("centre") * (1 - F.col("centre"))).alias("noise"), F.count(F.lit(1)).alias("m"),
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["m"] or r["m"] < 2 or not r["noise"]:
        return STRONGEST
    room = r["n"] - r["nn"] / r["n"] - (r["m"] - 1)
    rho = (r["spread"] / r["noise"] - (r["m"] - 1)) / room if room > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """From ``host, bad`` (null: no label): ``host, n_labelled, rate, deviation`` of the posterior bad rate."""
    hosts = stage(outcomes.groupBy("host").agg(
        F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"), F.count("bad").alias("n")
    ).select("host", domain_of(F.col("host"), suffixes).alias("domain"),
             suffix_of(F.col("host"), suffixes).alias("suffix"), "k", "n"), "url-hosts")
    domains = stage(hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "url-domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    all_ = suffixes.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    rate = ((all_["k"] or 0) + 1) / ((all_["n"] or 0) + 2)
    level = suffixes.withColumn("centre", F.lit(rate))
    for key, below in (("suffix", domains), ("domain", hosts), ("host", None)):
        s = _strength(level)
        a, b = F.lit(s) * F.col("centre") + F.col("k"), F.lit(s) * (1 - F.col("centre")) + F.col("n") - F.col("k")
        level = level.withColumn("rate", a / (a + b)).withColumn("deviation", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
        if below is not None:
            level = stage(below.join(level.select(key, F.col("rate").alias("centre")), key), "url-level")
    return level.select("host", F.col("n").alias("n_labelled"), "rate", "deviation")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id",
               url_col: str = "url", label_id: str = "doc_id", bad: Column | None = None, limit: float = 0.5,
               z: float = 2.0, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Per input row: ``<id_col>, host, path, rule, verdict, bad_rate, bad_bound`` (posterior mean and lower bound).

    ``suffixes``: public suffixes of several labels; ``bad``: outcome expression over ``labels`` (default: quality is 0 or toxic is 1)."""
    if bad is None:
        bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.coalesce(F.col("quality") == 0, F.lit(False)) |
                     F.coalesce(F.col("toxic") == 1, F.lit(False)))
    url = F.col(url_col)
    src = pages.select(F.col(id_col).alias("_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    marks = labels.select(F.col(label_id).alias("_of"), bad.cast("int").alias("_bad")).groupBy("_of").agg(F.max("_bad").alias("_bad"))
    outcomes = src.join(marks, F.col("_id") == F.col("_of"), "left").select("host", F.col("_bad").alias("bad"))
    known = reputation(outcomes, suffixes).select("host", F.col("rate").alias("bad_rate"),
                                        F.greatest(F.lit(0.0), F.col("rate") - z * F.col("deviation")).alias("bad_bound"))
    judged = src.join(known, "host", "left")
    host, path = F.col("host"), F.col("path")
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", longest_rule(host, path, rules, 0).alias("rule"),
        F.coalesce(longest_rule(host, path, rules, 1),
                   F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "bad_rate", "bad_bound")
