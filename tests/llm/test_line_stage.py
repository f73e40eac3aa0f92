"""The pipeline's line stage, at its own parameters, against the plain version."""

import corpus_pipeline as C
import pytest
from brute import words
from llm_edges import DIR
from test_dedup import deleted
from test_line_default import _two_line_passages


@pytest.mark.parametrize("made", [False, True])
def test_stage_equals_plain_version(spark, made):
    docs = spark.read.parquet(DIR + "/documents.parquet")
    if made:
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in _two_line_passages()], docs.schema)
    else:
        docs = C.stage(C.quality(spark, docs, DIR), "quality")
    after = {r["doc_id"]: r for r in C.lines(spark, docs, DIR).collect()}
    for i, ls, gone in deleted(sorted((r["doc_id"], r["text"]) for r in docs.collect())):
        left = [x for k, x in enumerate(ls) if k not in gone]
        now = [tuple(words(x)) for x in after[i]["text"].split("\n") if words(x)] if i in after else []
        assert now == left, i
        assert left or not ls or i not in after
