"""Quality rules by weak supervision (DataFrame functions only).

Rules look at counts of a whole text and vote good (+1), bad (-1) or abstain (0).  Nothing says how good a
rule is: expectation-maximisation over the table of vote patterns estimates, for a hidden good/bad class,
how often each rule casts each vote in either class; the posterior probability of "good" then replaces an
all-rules-must-pass filter.

Scale: one pass over the texts makes a narrow table of counts (written once); the EM loop works on vote
patterns with their frequencies (at most 3^rules rows whatever the corpus), one small aggregate per round.

Edge cases: null and empty texts have zero counts and ``base_failed``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legible.llm.common import stage, words

SYMBOLS = r"[#*$%&|<>]"
GRAM = 8
ROUNDS = 15
#: Prior of a rule's votes in either class, worth ``PRIOR_ROWS`` texts: it names the classes (a bad vote is rare among good texts).
PRIOR_ROWS = 20.0
IF_GOOD, IF_BAD = {1: 0.68, 0: 0.30, -1: 0.02}, {1: 0.2, 0: 0.4, -1: 0.4}


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words covered by 8-word windows found twice or more.  ``hashes``: window hashes in order.

    Only texts that hold a repeated hash pay for the sort; coverage adds min(8, gap) over sorted positions."""
    tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(None)).otherwise(tagged)


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text: ``_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the
    inputs of the other rules."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    df = df.select("_id", "_text", words(F.col("_text")).alias("_w"),
                   F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    df = df.select(
        "_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"[.!?:;][\"')\]]?[\x20\x09-\x0D]*$"))).cast("long").alias("n_closed_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count(text, F.lit(r"[!#$%&*|?]{2}")).cast("long").alias("n_runs"),
        F.size(F.filter("_w", lambda x: x.rlike(r"^[\p{L}\p{M}'-]+[.,;:!?]?$"))).cast("long").alias("n_plain"),
        F.size(F.filter("_w", lambda x, i: x == F.get("_w", i - 1))).cast("long").alias("n_stutter"),
        F.when(F.size("_w") >= GRAM, F.transform(
            F.sequence(F.lit(1), F.size("_w") - (GRAM - 1)),
            lambda i: F.xxhash64(F.slice("_w", i, GRAM)))).otherwise(F.array().cast("array<bigint>")).alias("_g"))
    df = df.withColumn("_t", _repeat_words(F.col("_g"), F.col("n_words"))).drop("_g")
    # positions whose hash also stands next to them in hash order, back in text order
    df = df.withColumn("_p", F.when(F.col("_t").isNull(), F.lit(None)).otherwise(F.sort_array(F.filter(
        F.transform("_t", lambda x, k: F.when(
            ((k > 0) & (F.get("_t", k - 1)["h"] == x["h"])) | (F.get("_t", k + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull())))).drop("_t")
    covered = F.aggregate(
        F.transform("_p", lambda i, k: F.least(F.lit(GRAM), F.coalesce(F.get("_p", k + 1) - i, F.lit(GRAM)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Rule name -> vote column over the counts of :func:`signals`."""
    n = F.col("n_words")
    mean = _share("word_chars", "n_words")
    return {
        "length": _vote(n >= 30, n < 20),
        "word_length": _vote((mean >= 2) & (mean <= 9), (mean < 1.5) | (mean > 14)),
        "symbols": _vote(_share("n_symbols", "n_words") <= 0.02, _share("n_symbols", "n_words") > 0.10),
        "symbol_runs": _vote(_share("n_runs", "n_words") <= 0.02, _share("n_runs", "n_words") > 0.10),
        "plain_words": _vote(_share("n_plain", "n_words") >= 0.85, _share("n_plain", "n_words") < 0.60),
        "upper_case": _vote(_share("n_upper", "n_letters") <= 0.10, _share("n_upper", "n_letters") > 0.30),
        "same_lines": _vote((F.col("n_dup_lines") == 0), _share("n_dup_lines", "n_lines") > 0.30),
        "same_words": _vote(F.col("n_repeat_words") == 0, F.col("n_repeat_words") * 100 > n * 30),
        "stutter": _vote(_share("n_stutter", "n_words") <= 0.05, _share("n_stutter", "n_words") > 0.20),
        "closed_lines": _vote(_share("n_closed_lines", "n_lines") >= 0.5, _share("n_closed_lines", "n_lines") < 0.1),
    }


def _posterior(names: list[str], prior: float, odds: dict[str, dict[int, float]]) -> Column:
    """P(good | votes) as an expression over the vote columns."""
    z = F.lit(math.log(prior / (1 - prior)))
    for r in names:
        z = z + F.when(F.col(r) == 1, F.lit(odds[r][1])).when(F.col(r) == -1, F.lit(odds[r][-1])).otherwise(F.lit(odds[r][0]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, dict[int, float]]]:
    """EM over ``patterns`` (one row per vote pattern, frequency ``n``): prior of good and, per rule and vote,
    the log odds good : bad.  Starts from the share of good among a pattern's votes."""
    total = sum(F.col(r) for r in names)
    cast = sum(F.abs(F.col(r)) for r in names)
    start = (F.lit(0.5) + F.lit(0.45) * total / F.greatest(cast, F.lit(1)))
    # a clear bad vote weighs more than one good vote, since most rules vote good on most texts
    post = F.when(F.array_min(F.array(*[F.col(r) for r in names])) == -1, start * F.lit(0.5)).otherwise(start)
    prior, odds = 0.5, {}
    for _ in range(rounds):
        p = patterns.withColumn("_g", F.col("n") * post).withColumn("_b", F.col("n") * (1 - post))
        row = p.agg(F.sum("_g").alias("g"), F.sum("_b").alias("b"), *[
            F.sum(F.when(F.col(r) == v, F.col(c)).otherwise(0.0)).alias(f"{r}_{v + 1}_{c}")
            for r in names for v in (-1, 0, 1) for c in ("_g", "_b")]).first()
        g, b = row["g"] or 0.0, row["b"] or 0.0
        prior = min(0.99, max(0.01, (g + 1) / (g + b + 2)))
        a = PRIOR_ROWS
        odds = {r: {v: math.log(((row[f"{r}_{v + 1}__g"] or 0.0) + a * IF_GOOD[v]) / (g + a))
                    - math.log(((row[f"{r}_{v + 1}__b"] or 0.0) + a * IF_BAD[v]) / (b + a))
                    for v in (-1, 0, 1)} for r in names}
        post = _posterior(names, prior, odds)
    return prior, odds


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
                  rounds: int = ROUNDS) -> DataFrame:
    """Per row: ``<id_col>``, the counts, ``base_failed``, each rule's vote (``vote_<rule>``),
    ``quality`` (posterior of good) and ``kept`` (false if base_failed, else ``quality >= threshold``)."""
    names = list(rules())
    voted = stage(signals(docs, id_col, text_col).select("*", *[c.cast("int").alias(r) for r, c in rules().items()]),
                  "quality-votes")
    patterns = stage(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "quality-patterns")
    prior, odds = fit(patterns, names, rounds)
    base = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return voted.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (_posterior(names, prior, odds) >= threshold)).alias("kept"),
        _posterior(names, prior, odds).alias("quality"), *[F.col(r).alias(f"vote_{r}") for r in names])
