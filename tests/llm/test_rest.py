import base64
import hashlib
import itertools
import math
import zlib

import public_tokenizers as P
import sentencepiece
from brute import shingle_set, words
from legible.llm import lm, warc
from legible.llm.decontam import ItemIndex, contained_items
from legible.llm.quality import quality_rules
from legible.llm.queries import RULES, queries
from legible.llm.urls import judge_urls
from llm_edges import DIR, EDGE
from collections import Counter


# ------------------------------------------------------------------ language model

def test_lattice_is_the_sum_over_all_segmentations():
    pieces = {"▁": -3.0, "a": -1.5, "b": -2.0, "ab": -2.5, "▁a": -1.0, "aba": -4.0, "▁ab": -3.3}
    byte = [-8.0] * 256
    for word in ("abab", "aab", "bé", "a"):
        text, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            parts = [text[s:e] for s, e in zip([0, *ends], ends)]
            p = 1.0
            for x in parts:
                one = sum(byte[b] for b in x.encode())
                p *= (math.exp(pieces[x]) if x in pieces else 0) + (math.exp(one) if len(x) == 1 else 0)
            total += p
        assert abs(lm.lattice(word, pieces, byte, 4) - math.log(total)) < 1e-9


def _scores(rows):
    held = [zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    texts = [[w.encode().lower() for w in words(t)] for _, t in rows]
    c = Counter(w for h, ws in zip(held, texts) if not h for w in ws)
    train = held.count(False)
    n, v = sum(c.values()) + train, len(c) + (train > 0)
    tok = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    cuts = Counter(p for w in c for p in tok.encode(w.decode()))
    pieces, byte, end = lm.piece_scores([tok.id_to_piece(i) for i in range(tok.get_piece_size())], cuts, tok.eos_id())
    low = math.log10(n + 0.1 * (v + 1))

    def p(count, inside):
        return math.log10((count + v * math.exp(inside)) / (n + v)) if n else inside / math.log(10)

    for (i, _), h, ws in zip(rows, held, texts):
        inside = [lm.lattice(w.decode(), pieces, byte, 40) for w in ws]
        yield (i, h, len(ws) + 1, sum(w in c for w in ws) + (train > 0), n,
               sum(math.log10(c[w] + 0.1) - low for w in ws) + math.log10(train + 0.1) - low,
               sum(p(c[w], x) for w, x in zip(ws, inside)) + p(train, end))


def _same(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 1e-6 * max(1, abs(w[6]))


def test_op5_equals_plain_version(spark, documents):
    _same(queries()["op5_lattice_lm"](spark, DIR).collect(), _scores(documents))


def test_op5_edges(spark, edge, nothing):
    path = P.path("piece_bpe_32k.model")
    _same(lm.lattice_scores(edge, path).collect(), _scores(EDGE))
    assert lm.lattice_scores(nothing, path).count() == 0


# ------------------------------------------------------------------ url filter

def test_op7_rules(spark):
    urls = ["HTTP://A.Example.ORG/es/x?y", "http://example.org/en/1", "http://example.org", "https://notexample.org/en/12#a", "x",
            None, "http://shop.com/de/", "http://com/fr/a?b", "http://a.com/fr", "http://a.net/", "a://b://c/d", "http://org?x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, labels, RULES).collect()}
    assert got == {
        0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/1", "example.org/en/1", "block"),
        2: ("example.org", "", None, "allow"), 3: ("notexample.org", "/en/12", "org/", "allow"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("shop.com", "/de/", "com/de/", "block"), 7: ("com", "/fr/a", "com/fr/", "allow"),
        8: ("a.com", "/fr", None, "allow"), 9: ("a.net", "/", None, "allow"), 10: ("b:", "//c/d", None, "allow"),
        11: ("org", "", None, "allow")}


def test_op7_reputation(spark, nothing):
    pages, labels = [], []
    for k in range(600):
        host = "bad.net" if k < 60 else "few.net" if k < 62 else "sub.bad.net" if k < 64 else "good%d.net" % (k % 9)
        pages.append((k, "http://%s/%d" % (host, k)))
        if k < 62 or k >= 64:
            labels.append((k, 0 if k < 62 else 1, 0))
    df = spark.createDataFrame(pages, "page_id long, url string")
    rows = judge_urls(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES).collect()
    by = {r["host"]: r for r in rows}
    assert by["bad.net"]["verdict"] == "block" and all(r["verdict"] == "allow" for h, r in by.items() if h.startswith("good"))
    assert by["sub.bad.net"]["bad_rate"] > by["good1.net"]["bad_rate"]        # borrows from its domain
    assert by["few.net"]["bad_rate"] < by["bad.net"]["bad_rate"]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert judge_urls(df, none, RULES).filter("verdict = 'allow'").count() == 600
    assert judge_urls(df.limit(0), none, RULES).count() == 0


# ------------------------------------------------------------------ WARC

def _digest(t):
    return base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()


PAGES = [(1, "http://a/x", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c\r\nX: y", ""),
         (5, "http://d", "before WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n\r\n after"),
         (6, "http://e", "ünï \r\n\r\n\r\n\r\n" * 50), (7, "http://f", "x" * 300000), (8, "http://g", "same"), (1, "http://a/x", "same"),
         (None, "http://h", "same"), (9, "http://i", "WARC/1.1\r\n")]


def test_op8_round_trip(spark):
    path = warc.new_archive_path(spark)
    df = spark.createDataFrame([(i, u, h, "z") for i, u, h in PAGES], "page_id long, url string, html string, type string")
    warc.write_warc(df.repartition(2), path)
    captures = warc.assemble(warc.read_warc(spark, path))
    rows = captures.collect()
    assert len(rows) == len(PAGES) and all(r["request"]["block"].startswith("GET ") for r in rows)
    assert sorted(bytes(r["payload"]).decode() for r in rows if r["type"] == "response") == sorted(
        [h or "" for i, _, h in PAGES if h != "same" and i != 4] + ["same", "same"])
    got = sorted((tuple(r) for r in warc.captured_pages(captures).collect()), key=repr)
    want = []
    for i, _, h in PAGES:
        h = h or ""
        first = min(j for j, _, x in PAGES if (x or "") == h and j is not None)
        want.append((i, len(h.encode()), _digest(h), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=repr)


def test_op8_query_and_empty(spark):
    assert queries()["op8_warc_captures"](spark, DIR).count() == 50
    path = warc.new_archive_path(spark)
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captured_pages(warc.assemble(warc.read_warc(spark, path))).count() == 0


# ------------------------------------------------------------------ decontamination

def test_op9_equals_brute_force(spark, monkeypatch):
    import random

    from legible.llm import decontam
    rnd = random.Random(2)
    items = [(k, " ".join("w%d" % rnd.randrange(60) for _ in range(rnd.choice((1, 3, 5, 6, 9, 20, 60))))) for k in range(40)]
    items += [(41, None), (42, " "), (None, "w1 w2 w3 w4 w5 w6 w7")]
    docs = []
    for k in range(80):
        w = ["w%d" % rnd.randrange(60) for _ in range(rnd.randrange(40))]
        part = words(rnd.choice(items)[1])
        for _ in range(rnd.randrange(3)):
            if part:
                part[rnd.randrange(len(part))] = "zz"
        docs.append((k, " ".join(w + part + w[:5]).upper() if k % 3 else " ".join(part)))
    docs += EDGE

    def grams(text, n):
        return shingle_set(text, n) if len(words(text)) >= n else set()

    want = []
    for i, t in docs:
        hits = []
        for j, q in items:
            n = min(5, len(words(q)))
            if n and 100 * len(grams(q, n) & grams(t, n)) >= 80 * len(grams(q, n)):
                hits.append(j)
        want.append((i, sorted(hits, key=lambda x: (x is not None, x or 0))))
    a = spark.createDataFrame([(i, t, [0], 1.0) for i, t in docs], "doc_id long, text string, found array<int>, best double")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (10 ** 6, 30):
        monkeypatch.setattr(decontam, "BLOCK", block)
        got = [(r["doc_id"], list(r["item_ids"])) for r in contained_items(a, b).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert contained_items(a, b.limit(0)).filter("contaminated").count() == 0
    assert contained_items(a.limit(0), b).count() == 0
    assert ItemIndex([], 5, 80).classes == []


# ------------------------------------------------------------------ quality rules

def _counts(text):
    import re
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[s:s + 8]) for s in range(len(w) - 7))
    hit = {k for s in range(len(w) - 7) if grams[tuple(w[s:s + 8])] > 1 for k in range(s, s + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_op10_counts_and_verdicts(spark, documents, edge, nothing):
    rows = {r["doc_id"]: r for r in queries()["op10_quality_rules"](spark, DIR).collect()}
    for i, t in documents:
        c = _counts(t)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == c
        assert r["base_failed"] == (c[0] < 20 or 100 * c[4] > 30 * c[0]) and not (r["base_failed"] and r["kept"])
    got = sorted((r[0], tuple(r)[1:6]) for r in quality_rules(edge).filter("doc_id is not null").collect())
    assert got == sorted((i, _counts(t)) for i, t in EDGE if i is not None)
    assert quality_rules(nothing).count() == 0


def test_op10_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries()["op10_quality_rules"](spark, sf).join(spark.read.parquet(sf + "/labels.parquet"), "doc_id").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)


def _em(patterns, n_rules, rounds=15):
    """The same EM in plain numbers.  patterns: (votes, frequency)."""
    def start(v):
        s = 0.5 + 0.45 * sum(v) / max(1, sum(map(abs, v)))
        return s * 0.5 if min(v) == -1 else s

    post = [start(v) for v, _ in patterns]
    for _ in range(rounds):
        g = sum(n * p for (_, n), p in zip(patterns, post))
        b = sum(n * (1 - p) for (_, n), p in zip(patterns, post))
        prior = min(0.99, max(0.01, (g + 1) / (g + b + 2)))
        odds = []
        for r in range(n_rules):
            odds.append({})
            for x, u, w in ((1, 0.68, 0.2), (0, 0.3, 0.4), (-1, 0.02, 0.4)):
                gx = sum(n * p for (v, n), p in zip(patterns, post) if v[r] == x)
                bx = sum(n * (1 - p) for (v, n), p in zip(patterns, post) if v[r] == x)
                odds[r][x] = math.log((gx + 20 * u) / (g + 20)) - math.log((bx + 20 * w) / (b + 20))
        post = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(odds[r][x] for r, x in enumerate(v))))) for v, _ in patterns]
    return dict(zip([v for v, _ in patterns], post))


def test_op10_posterior_equals_plain_em(spark):
    rows = quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    votes = [c for c in rows[0].asDict() if c.startswith("vote_")]
    freq = Counter(tuple(r[c] for c in votes) for r in rows)
    post = _em(sorted(freq.items()), len(votes))
    for r in rows:
        assert abs(r["quality"] - post[tuple(r[c] for c in votes)]) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
