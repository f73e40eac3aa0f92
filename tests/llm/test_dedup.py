import random

from brute import sha, words
from legible.llm.lines import line_dedup
from legible.llm.queries import queries
from legible.llm.substring import substring_dedup
from llm_edges import DIR, EDGE


def cut(rows, size=20):
    """rows: (id, text).  (id, words, removed, kept) of each row."""
    def order(i, s):
        return (i is not None, i or 0, s)

    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            g = tuple(w[s:s + size])
            first[g] = min(first.get(g, order(i, s)), order(i, s))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s:s + size])] < order(i, s):
                gone.update(range(s, s + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op1_equals_brute_force(spark, documents):
    want = sorted(((i, n, m, sha(k)) for i, n, m, k in cut(documents)), key=repr)
    assert _rows(queries()["op1_substring_dedup"](spark, DIR)) == want


def test_op1_hot_minimisers_and_edges(spark, edge, nothing):
    rnd = random.Random(5)
    passage = ["p%d" % i for i in range(60)]
    rows = [(k, " ".join(["a%d" % rnd.randrange(50) for _ in range(rnd.randrange(30))] + passage[rnd.randrange(20):40 + rnd.randrange(20)]
                         + ["b%d" % rnd.randrange(9) for _ in range(rnd.randrange(40))])) for k in range(120)]
    rows += [(200, "x y " * 40), (201, "x y " * 25), (3, "z " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2, 2000):
        assert _rows(substring_dedup(df, hot=hot)) == cut(rows)
    assert _rows(substring_dedup(edge, hot=3)) == cut(EDGE)
    assert substring_dedup(nothing).count() == 0


def deleted(rows, min_words=50):
    """Line numbers (of lines with a word) under repeated pairs of lines or repeated long lines, per row."""
    lines = [(i, [tuple(words(x)) for x in (t or "").split("\n")]) for i, t in rows]
    lines = [(i, [x for x in ls if x]) for i, ls in lines]
    first, out = {}, []
    for i, ls in lines:
        for s in range(len(ls)):
            for g in ([(ls[s], ls[s + 1])] if s + 1 < len(ls) else []) + ([ls[s]] if len(ls[s]) >= min_words else []):
                first[g] = min(first.get(g, (i is not None, i or 0, s)), (i is not None, i or 0, s))
    for i, ls in lines:
        gone = set()
        for s in range(len(ls)):
            if s + 1 < len(ls) and first[ls[s], ls[s + 1]] < (i is not None, i or 0, s):
                gone |= {s, s + 1}
            if len(ls[s]) >= min_words and first[ls[s]] < (i is not None, i or 0, s):
                gone.add(s)
        out.append((i, ls, gone))
    return out


def _kept(text):
    return [tuple(words(x)) for x in (text or "").split("\n") if words(x)]


def _line_rows():
    rnd = random.Random(11)
    pool = ["line %d of the pool" % k for k in range(40)] + [" ".join("long%d_%d" % (k, j) for j in range(55)) for k in range(4)]
    rows = []
    for k in range(80):
        ls = []
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(36)
            ls += rnd.choice([["own %d %d" % (k, rnd.randrange(10 ** 6))], pool[at:at + rnd.randrange(1, 6)], [""], [rnd.choice(pool[40:])]])
        rows.append((k, "\n".join(ls)))
    return rows


def test_op4_without_thinning_equals_brute_force(spark, documents):
    for rows in (documents, _line_rows()):
        got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=1).collect()}
        for i, ls, gone in deleted(rows):
            assert _kept(got[i]["kept"]) == [x for k, x in enumerate(ls) if k not in gone], i
            assert (got[i]["n_lines"], got[i]["n_deleted"]) == (len(ls), len(gone))


def test_op4_winnowed_is_sound_and_keeps_its_guarantee(spark, documents):
    for rows in (documents, _line_rows()):
        got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        seen = set()
        for i, ls, gone in deleted(rows):
            kept = _kept(got[i]["kept"])
            must = [x for k, x in enumerate(ls) if k not in gone]
            it = iter(kept)
            assert all(x in it for x in must), i                       # only repeated lines go
            assert not [x for k, x in enumerate(ls) if len(x) >= 50 and k in gone and x in kept and ls.count(x) == 1]
            runs = {tuple(ls[s:s + 3]) for s in range(len(ls) - 2)}
            for run in runs & seen:                                     # a repeated run of three lines loses two or more
                assert sum(x in kept for x in run) <= 1 or len(set(ls)) < len(ls)
            seen |= runs


def test_op4_query_and_edges(spark, edge, nothing):
    assert queries()["op4_line_dedup"](spark, DIR).count() == 200
    got = {(r["doc_id"], r["n_lines"], r["n_deleted"], r["kept"]) for r in line_dedup(edge).collect()}
    assert got == {(i, sum(bool(words(x)) for x in (t or "").split("\n")), 0, t) for i, t in EDGE}
    assert line_dedup(nothing).count() == 0
