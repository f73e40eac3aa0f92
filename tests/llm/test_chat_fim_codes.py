"""Operators 11 to 13 on small tables against plain versions, with the edge cases of their docstrings."""

import random
import re

import numpy as np
import pytest
from brute import sha
from legible.llm import chat, codes, fim
from llm_edges import EDGE
from pyspark.sql import functions as F

# ------------------------------------------------------------------ chat formatting

NASTY = ["", "plain", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>x", "a<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n", "<", "<|im_end|",
         "im_start|>", "\n", "\\", "<|other|>", "日本 <|im_start|>", "tail<", "<\\", "<|im_<|im_end|>end|>"]
ROLES = ["user", "assistant", "", "a\nb", "a\\nb", "<|im_start|>", "\\", "\\l", "\\\\n", "x<y"]


def plain_parse(text):
    """A hand-written reader of the documented grammar."""
    out = []
    while text:
        assert text.startswith("<|im_start|>")
        role, text = text[12:].split("\n", 1)
        raw, text = text.split("<|im_end|>\n", 1)
        role = re.sub(r"\\(\\|n|l)", lambda m: {"\\": "\\", "n": "\n", "l": "<"}[m[1]], role)
        out.append((role, re.sub(r"<\\(\\*)\|(im_start|im_end)\|>", r"<\1|\2|>", raw)))
    return out


def _read(df):
    got = df.select("conv_id", "n_turns", "formatted", "spans", "n_escaped", chat.parse_turns(F.col("formatted")).alias("turns"),
                    chat.loss_texts(F.col("formatted"), F.col("spans")).alias("loss")).collect()
    return {r["conv_id"]: r for r in got}


def test_formatted_text_parses_back_for_every_text_and_role(spark):
    rows = [(i, k, r, t) for i, r in enumerate(ROLES) for k, t in enumerate(NASTY)]
    rng = random.Random(3)
    bits = ["<", "|", "\\", "im_end", "im_start", "|>", "<|", "\n", "é"]
    rows += [(100 + i, k, rng.choice(ROLES), "".join(rng.choices(bits, k=9))) for i in range(40) for k in range(6)]
    got = _read(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for conv, r in got.items():
        want = [(b, t) for c, _, b, t in rows if c == conv]
        assert [tuple(x) for x in r["turns"]] == want == plain_parse(r["formatted"])
        assert r["loss"] == [t for b, t in want if b == "assistant"]
        assert r["n_turns"] == len(want)
        for (_, text), span in zip(want, r["spans"]):
            assert chat_unescape(r["formatted"][span["start"]:span["stop"]]) == text
            assert r["formatted"][span["begin"]:].startswith("<|im_start|>")


def chat_unescape(raw):
    return re.sub(r"<\\(\\*)\|(im_start|im_end)\|>", r"<\1|\2|>", raw)


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "a < b | c \\ <|x|>"), (1, 1, "assistant", "<|im_end|>"), (1, 2, "user", "<\\|im_end|>")]
    r = _read(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))[1]
    assert r["n_escaped"] == 2
    assert r["formatted"] == ("<|im_start|>user\na < b | c \\ <|x|><|im_end|>\n<|im_start|>assistant\n<\\|im_end|><|im_end|>\n"
                              "<|im_start|>user\n<\\\\|im_end|><|im_end|>\n")


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", None, "x"), (1, None, None, "first", "x"), (1, 1, "assistant", "tie", "x"), (1, 1, "assistant", "tie", "x"),
            (None, 0, "assistant", "no id", "x"), (2, 0, "user", "w" * 300_000 + "<|im_end|>", "x")]
    got = _read(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _c string")))
    assert [tuple(t) for t in got[1]["turns"]] == [("", "first"), ("assistant", ""), ("assistant", "tie"), ("assistant", "tie")]
    assert got[1]["loss"] == ["", "tie", "tie"]
    assert got[None]["loss"] == ["no id"] and got[2]["turns"][0]["text"].endswith("w<|im_end|>")
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(none).count() == 0


def test_a_broken_text_does_not_parse(spark):
    bad = ["x", "<|im_start|>user", "<|im_start|>user\nno end", "<|im_start|>u\nx<|im_end|>", "<|im_start|>u\nx<|im_end|>\ny"]
    df = spark.createDataFrame([(b,) for b in bad], "t string").select(chat.parse_turns(F.col("t")).alias("p"))
    assert all(None in r["p"] for r in df.collect())
    with pytest.raises(ValueError):
        chat.Template(start="a<b")


def test_another_template(spark):
    t = chat.Template("turn", "stop", ("bot",))
    df = spark.createDataFrame([(1, 0, "bot", "<|stop|><|im_end|>")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df, t).select("formatted", chat.loss_texts(F.col("formatted"), F.col("spans"), t).alias("l")).first()
    assert r["formatted"] == "<|turn|>bot\n<\\|stop|><|im_end|><|stop|>\n" and r["l"] == ["<|stop|><|im_end|>"]


def test_formatting_has_no_python_and_one_exchange(spark):
    df = chat.format_chats(spark.createDataFrame([(1, 0, "a", "b")], "conv_id long, turn long, role string, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


# ------------------------------------------------------------------ fill in the middle

def plain_fim(key, text, percent=90, spm=20):
    n = len(text)
    h = sha(f"1:{key}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in fim.SENTINELS) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block", [4096, 7])
def test_fim_equals_the_plain_version(spark, edge, block):
    rng = random.Random(5)
    more = [(100 + i, "".join(rng.choices("aé日𝄞 \n<>PSM", k=rng.randint(0, 400)))) for i in range(150)]
    docs = edge.select("doc_id", "text", "_id", "n").unionByName(spark.createDataFrame([(i, t, "", 0) for i, t in more], "doc_id long, text string, _id string, n long"))
    got = fim.fill_in_middle(docs, block=block).withColumn("back", fim.restored()).collect()
    want = [(i, t or "", *plain_fim("" if i is None else i, t or "")) for i, t in [*EDGE, *more]]
    assert sorted(map(repr, [(r["doc_id"], r["back"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got])) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 3, 8, 4096])
def test_block_tree_finds_every_cut(block):
    for text in ("", "a", "aé日𝄞" * 9, "one  two\nthree   four " * 7, "x" * 50):
        raw = text.encode()
        points = fim.BlockTree(raw, None, block)
        assert points.n_units == points.n_points == len(text)
        for k in range(len(text) + 1):
            assert points.cut(k) == (len(text[:k].encode()), k)
        words = fim.BlockTree(raw, re.compile(rb"\S+\s*"), block)
        starts = [m.start() for m in re.finditer(r"\S+\s*", text)] + [len(text)]
        assert words.n_units == len(starts) - 1
        for k, at in enumerate(starts):
            assert words.cut(k) == (len(text[:at].encode()), at)


def test_sentinels_and_an_empty_table(spark, nothing):
    docs = spark.createDataFrame([(i, "text with <M> inside") for i in range(50)], "doc_id long, text string")
    assert {r["form"] for r in fim.fill_in_middle(docs).collect()} == {"plain"}
    assert fim.fill_in_middle(nothing).count() == 0
    # a sentinel that overlaps the text around it: the output is kept only if it parses back
    docs = spark.createDataFrame([(i, "aXaXa" * 5) for i in range(80)], "doc_id long, text string")
    out = fim.fill_in_middle(docs, sentinels=("XX", "aXX", "XXa"), unit=None).collect()
    marks = (b"XX", b"aXX", b"XXa")
    assert all(fim.recovered(r["output"].encode(), r["form"], marks) == b"aXaXa" * 5 for r in out)


def test_fim_makes_no_shuffle(spark, edge):
    assert "Exchange" not in fim.fill_in_middle(edge)._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ vector codes

def plain_codes(rows, parts, entries, rounds, scale=1024):
    """rows: (id, vector, label), usable and of one length."""
    q = [[int(np.floor(np.float64(x) * scale)) for x in v] for _, v, _ in rows]
    w = len(q[0]) // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for p in range(parts)] for v in q]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, q[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = [near(p, c[p])[1] for c in cut]
            new = list(books[p])
            for e in set(of):
                mine = [c[p] for c, x in zip(cut, of) if x == e]
                new[e] = tuple(sum(col) // len(mine) for col in zip(*mine))
            books[p] = new
    out = []
    for (i, _, label), c in zip(rows, cut):
        found = [near(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join("%02x" % e for _, e in found), sum(d for d, _ in found)))
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    return sorted(map(repr, [(*r, total[r[1]]) for r in out])), sha(",".join(str(x) for b in books for e in b for x in e))


def _codes(df, **kw):
    out, books = codes.compress_vectors(df, **kw)
    return sorted(map(repr, [(r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in out.collect()])), codes.books_sha256(books)


SCHEMA = "vec_id long, embedding array<float>, label int, _id string, q long"


@pytest.mark.parametrize("entries", [5, 40, 256])
def test_codes_equal_the_plain_version(spark, entries):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(300, 8)).astype(np.float32)
    vecs[50:120] = vecs[:70]                                              # copies: ties between equal entries
    vecs[200:] = np.round(vecs[200:])                                     # few values: ties between different entries
    rows = [(i, [float(x) for x in v], None if i % 7 == 0 else i % 3) for i, v in enumerate(vecs)] + [(None, [0.5] * 8, 1), (3, [0.25] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    assert _codes(df, entries=entries) == plain_codes(rows, 4, entries, 4)


def test_unusable_vectors_and_small_tables(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [-1.0, 0.001, -0.001, 4.0], None)]
    bad = [(0, None, 1), (3, [1.0, None, 2.0, 3.0], 1), (4, [float("nan")] * 4, 1), (5, [float("inf")] * 4, 1), (6, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], SCHEMA)
    assert _codes(df) == plain_codes(rows, 4, 256, 4)
    for empty in (df.limit(0), df.filter("vec_id = 0")):
        out, books = codes.compress_vectors(empty)
        assert out.count() == 0 and codes.books_sha256(books) == sha("")
    with pytest.raises(ValueError):
        codes.compress_vectors(df, parts=3)


def test_tree_search_equals_brute_force_and_leaves_out_subtrees():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 6))
    points = centres[rng.integers(0, 16, 256)] + rng.integers(-40, 40, (256, 6))
    points[100:120] = points[0]                                           # equal entries: the lowest index wins
    queries = np.concatenate([points[rng.integers(0, 256, 500)] + rng.integers(-30, 30, (500, 6)), points, rng.integers(-5000, 5000, (500, 6))])
    tree = codes.Gnat(points)
    index, d = tree.nearest(queries)
    full = ((queries[:, None, :] - points[None]) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (d == full.min(1)).all()
    assert tree.tested < 0.6 * full.size
    # components past the exact range of doubles
    big = points * (1 << 16)
    assert (codes.Gnat(big).nearest(big)[1] == 0).all()
    with pytest.raises(ValueError):
        codes.squares(np.array([[1 << 60]]), np.array([[-(1 << 60)]]))


def test_grid_ties_go_to_the_lower_index():
    points = np.array([[x, y] for x in range(0, 20, 2) for y in range(0, 20, 2)])
    queries = np.array([[x, y] for x in range(-1, 21) for y in range(-1, 21)])
    full = ((queries[:, None, :] - points[None]) ** 2).sum(2)
    for order in (np.arange(100), np.random.default_rng(0).permutation(100)):
        index, _ = codes.Gnat(points[order], arity=4).nearest(queries)
        assert (index == full[:, order].argmin(1)).all()
