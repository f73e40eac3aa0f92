"""Line dedup over line hashes (DataFrame functions only).

A line counts if it has a word; lines compare by their words (two 64-bit hashes).  What can go is a run of ``min_lines``
consecutive lines that count, or of fewer with ``min_words`` words or more.  Winnowing chooses a line of each such run,
the one of smallest hash in its first ``window`` lines (the last of equals), whatever stands around the run, so equal runs
choose equal lines: a line hash chosen at one position only ends the search.  Where it was chosen again, the match is
extended to both sides of the chosen line, to the whole run, and each run is joined to its first place (in order of
id and line), never to all others.  Later places go, line by line; longer repeats are the union of their runs, none is
lost by the choice.  Runs are judged on the input.

Scale: rows are chosen lines and runs, their number is linear in the lines, also if all lines of a document are equal.  Counts of
chosen lines and first places are partial aggregates, and both are joined as unique keys, so a line that a third of
the corpus holds is split at run time.  Texts move once, to meet their deletions.

Edge cases: null text is the empty text (and stays null if nothing is deleted); blank lines stay; null ids
sort first; rows that repeat id and text are copies of one document, not repeats of each other; rows of one id with other texts are
not repeats of each other at the same line; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legible.llm.common import stage, words

BLANK = r"^[\x20\x09-\x0D]*$"


def chosen(hashes: Column, start: Column, size: int) -> Column:
    """Hash ``h`` and negative position ``i`` of the minimum of ``size`` hashes from ``start`` (from 0) on, the last one of equals."""
    return F.array_min(F.transform(F.sequence(start, start + (size - 1)), lambda i: F.struct(F.get(hashes, i).alias("h"), (-i).alias("i"))))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _run_table(src: DataFrame, min_lines: int, min_words: int, window: int) -> DataFrame:
    """A row per run that can go: ``_id, _k`` (text key), hash ``a`` and place ``at`` of its chosen line, its own hashes
    ``f, g``, line numbers ``i`` of its first and ``e`` of its last line."""
    df = src.select("_id", "_k", F.filter(F.transform(
        F.split(F.coalesce("_text", F.lit("")), "\n", -1), lambda x, i: F.struct(words(x).alias("x"), i.alias("p"))),
        lambda x: F.size(x["x"]) > 0).alias("l"))
    df = df.select("_id", "_k", F.transform("l", lambda x: F.xxhash64(x["x"])).alias("h"),
                   F.transform("l", lambda x: F.xxhash64(F.lit("line"), x["x"])).alias("v"),
                   F.transform("l", lambda x: F.size(x["x"])).alias("w"), F.col("l.p").alias("p"))

    def runs(n: int) -> Column:
        starts = F.filter(F.transform("h", lambda h, i: i), lambda i: i + n <= F.size("h"))
        if n < min_lines:
            starts = F.filter(starts, lambda i: _total(F.slice("w", i + 1, n)) >= min_words)
        return F.transform(starts, lambda i: F.struct(
            chosen(F.col("h"), i, min(n, window)).alias("c"), F.xxhash64(F.slice("h", i + 1, n)).alias("f"),
            F.xxhash64(F.slice("v", i + 1, n)).alias("g"), F.get("p", i).alias("i"), F.get("p", i + (n - 1)).alias("e")))

    df = df.select("_id", "_k", F.explode(F.concat(*[runs(n) for n in range(1, min_lines + 1)])).alias("r"))
    return df.select("_id", "_k", F.col("r.c.h").alias("a"), F.xxhash64("_id", "_k", "r.c.i").alias("at"), "r.f", "r.g", "r.i", "r.e")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2,
               min_words: int = 50, window: int | None = None, carry: str | None = None) -> DataFrame:
    """Per input row: ``<id_col>, n_lines`` (that count), ``n_deleted, kept`` (the text without the deleted lines), and the
    whole input row as a struct ``carry`` if that is named.  ``window`` (1 to ``min_lines``, the default) changes the number
    of chosen lines, not the result."""
    window = window or min_lines
    if not 1 <= window <= min_lines:
        raise ValueError("window must be 1 to min_lines")
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_k"),
                      *([F.struct(*docs.columns).alias("_row")] if carry else []))
    runs = stage(_run_table(src, min_lines, min_words, window), "line-runs")
    again = runs.groupBy("a").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo < hi").select("a")
    runs = stage(runs.join(again, "a", "left_semi").select("_id", "_k", "f", "g", "i", "e"), "line-again")

    first = (runs.groupBy("f", "g").agg(F.min(F.struct("_id", "i")).alias("o"), F.count(F.lit(1)).alias("m")).filter("m > 1")
             .select(F.col("f").alias("_f"), F.col("g").alias("_g"), "o"))
    later = runs.join(first, (runs["f"] == first["_f"]) & (runs["g"] == first["_g"])).filter(
        ~(F.col("_id").eqNullSafe(F.col("o._id")) & (F.col("i") == F.col("o.i"))))
    gone = later.groupBy("_id", "_k").agg(F.collect_set(F.struct("i", "e")).alias("gone")).select(
        F.col("_id").alias("gid"), F.col("_k").alias("gk"),
        F.array_distinct(F.flatten(F.transform("gone", lambda r: F.sequence(r["i"], r["e"])))).alias("gone"))

    full = src.join(gone, src["_id"].eqNullSafe(gone["gid"]) & (src["_k"] == gone["gk"]), "left")
    full = full.select("_id", "_text", "gone", F.split("_text", "\n", -1).alias("l"), *(["_row"] if carry else []))
    at = F.sequence(F.lit(0), F.size("l") - 1)
    full = full.withColumn("gone", F.array_except("gone", F.filter(at, lambda i: F.get("l", i).rlike(BLANK))))
    left = F.array_except(at, "gone")
    return full.select(
        F.col("_id").alias(id_col),
        F.coalesce(F.size(F.filter("l", lambda x: ~x.rlike(BLANK))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
        F.when(F.col("gone").isNull(), F.col("_text")).otherwise(
            F.array_join(F.transform(left, lambda i: F.get("l", i)), "\n")).alias("kept"),
        *([F.col("_row").alias(carry)] if carry else []))
