"""Training-corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and reread as the
next stage's documents.  Each works on all rows that its predecessor kept and all but the last return the columns
of ``documents``.

Edge cases: null and empty texts fail the quality rules; rows that repeat an id are judged each on their own,
except that the near-duplicate stage keeps or drops all rows of an id; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legible.llm import bpe
from legible.llm.common import read, stage
from legible.llm.decontam import contained_items
from legible.llm.lines import line_dedup
from legible.llm.near import jaccard_join
from legible.llm.quality import quality_rules

RANKS = "byte_bpe_50k.tiktoken"


def _rows(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, for operators that hand an id through."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the rules' posterior keep."""
    key = F.struct(F.col("doc_id").alias("_of"), F.xxhash64("text").alias("_k"))
    kept = quality_rules(docs.select(key.alias("row"), "text"), id_col="row").filter("kept").select("row.*").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_of"]) & (F.xxhash64(docs["text"]) == kept["_k"]), "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without line runs seen earlier; a document of which no line is left goes."""
    cut = line_dedup(docs, carry="row").filter("n_deleted = 0 or n_deleted < n_lines")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_deleted") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[new.get(c, F.col(f"row.{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each near-duplicate group: five-word shingles, Jaccard 0.8 or more."""
    kept = (jaccard_join(docs, n=5, percent=80).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("_kept")).distinct())
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    hits = contained_items(_rows(docs), read(spark, sf_dir, "benchmark"), id_col="row")
    return hits.filter("not contaminated").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the check that they decode to it."""
    path = public_tokenizers.path(RANKS)
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    coded = bpe.round_trip(rows, path, public_tokenizers.PATTERN, id_col="row")
    return coded.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near),
          ("decontamination", decontaminate), ("byte_bpe", tokens)]

#: Posterior quality and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
