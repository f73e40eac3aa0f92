"""Line dedup on documents whose own lines repeat: linear work, same result as the plain version."""

import random

import pytest
from legible.llm.lines import line_dedup
from test_dedup import _kept, deleted


def test_many_equal_lines_in_one_document(spark):
    rows = [(1, "same old line\n" * 20000), (2, "own\n\nsame old line\n \nsame old line\nend"), (3, "a\nb\n" * 9000), (4, "same old line")]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_lines"], got[1]["n_deleted"], got[1]["kept"]) == (20000, 19999, "same old line\n")
    assert (got[2]["n_deleted"], got[2]["kept"]) == (2, "own\n\n \nend")
    assert (got[3]["n_deleted"], got[3]["kept"]) == (17998, "a\nb\n")
    assert (got[4]["n_deleted"], got[4]["kept"]) == (0, "same old line")


def test_repeats_of_few_lines_equal_plain_version(spark):
    rnd = random.Random(3)
    rows = [(k, "\n".join(rnd.choice(["x", "y y", "z", "", "w " * 55, "own %d" % rnd.randrange(500)]) for _ in range(rnd.randrange(40)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (None, 1):
        got = {r["doc_id"]: r for r in line_dedup(df, window=window).collect()}
        for i, ls, gone in deleted(rows):
            assert _kept(got[i]["kept"]) == [x for k, x in enumerate(ls) if k not in gone], i
            assert got[i]["n_deleted"] == len(gone)


def test_window_beyond_the_smallest_run_is_refused(spark, nothing):
    with pytest.raises(ValueError):
        line_dedup(nothing, window=3)
