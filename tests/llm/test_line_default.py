"""Line dedup at its default parameters against the plain version."""

from legible.llm.lines import line_dedup
from test_dedup import _kept, _line_rows, deleted


def _two_line_passages():
    """29 + 28 words on two lines, between lines of each document's own; and longer runs that an earlier document holds in part."""
    rows = []
    for k in range(40):
        two = [" ".join("a%d_%d" % (k, j) for j in range(29)), " ".join("b%d_%d" % (k, j) for j in range(28))]
        run = ["run %d line %d" % (k, j) for j in range(5)]
        for c, part in enumerate((run[1:3], run[:4], run)):
            rows.append((3 * k + c, "\n".join(["own %d %d x" % (k, c)] + two + ["own %d %d y" % (k, c)] + part + ["own %d %d z" % (k, c)])))
    return rows


def test_op4_default_equals_brute_force(spark, documents):
    for rows in (documents, _line_rows(), _two_line_passages()):
        got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i, ls, gone in deleted(rows):
            assert _kept(got[i]["kept"]) == [x for k, x in enumerate(ls) if k not in gone], i
            assert got[i]["n_deleted"] == len(gone)


def test_op4_fewer_lines_of_many_words(spark):
    rows = _two_line_passages()
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=3).collect()
    for r in got:
        left = [x for x in _kept(r["kept"]) if x[0][0] in "ab" and "_" in x[0]]
        assert len(left) == (2 if r["doc_id"] % 3 == 0 else 0), r["doc_id"]
