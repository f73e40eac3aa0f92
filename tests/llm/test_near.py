import random

from brute import components, shingle_set
from legible.llm.near import jaccard_join
from legible.llm.queries import queries
from llm_edges import DIR, EDGE


def _rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_op6_equals_brute_force(spark, documents):
    assert _rows(queries()["op6_ngram_jaccard"](spark, DIR)) == sorted(components(documents), key=repr)


def _family(rnd, size, words, most):
    """Copies of one text with up to ``most`` words changed each."""
    base = ["w%d" % rnd.randrange(4000) for _ in range(words)]
    for _ in range(size):
        t = list(base)
        for _ in range(rnd.randint(0, most)):
            t[rnd.randrange(len(t))] = "x%d" % rnd.randrange(10 ** 6)
        yield " ".join(t)


def test_families_of_near_copies(spark):
    rnd = random.Random(7)
    texts = [t for size, n, most in ((60, 120, 8), (30, 12, 2), (40, 40, 4), (3, 300, 9), (25, 7, 1)) for t in _family(rnd, size, n, most)]
    texts += texts[::9]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    for percent in (85, 80):
        got = _rows(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent))
        assert got == sorted(components(rows, percent=percent), key=repr)


def test_edges(spark, edge, nothing):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(edge).collect()}
    for i, t in EDGE:
        n = len(shingle_set(t, 4))
        assert (i, n, 5 if n == 2 else i) in got
    assert jaccard_join(edge).count() == len(EDGE) and jaccard_join(nothing).count() == 0


def test_led_pairs_have_no_hot_end(spark):
    from legible.llm.near import _led

    star = [(bytes([0]), bytes([i])) for i in range(1, 101)] + [(bytes([i]), bytes([200])) for i in range(1, 41)]
    pairs = spark.createDataFrame(star, "a binary, b binary")
    led = [(bytes(r["end"]), bytes(r["hub"])) for r in _led(pairs).collect()]
    assert sorted(tuple(sorted(p)) for p in led) == sorted(tuple(sorted(p)) for p in star)
    ends = [e for e, _ in led]
    assert max(map(ends.count, set(ends))) ** 2 <= 2 * len(star)


def test_staged_buckets_are_dropped(spark):
    before = {t.name for t in spark.catalog.listTables()}
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + (" x" if i % 2 else "")) for i in range(40)]
    out = jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in out} == {0}
    assert {t.name for t in spark.catalog.listTables()} == before


def test_words_are_forgotten_after_a_task():
    from legible.llm import common

    def run(batches):
        for b in batches:
            common.word_hashes([b])
            assert common._MEMO
            yield b

    assert list(common.forgetting(run)(iter([b"a b", b"c"]))) == [b"a b", b"c"]
    assert not common._MEMO


def test_bitmap_keeps_every_wanted_id(spark):
    from pyspark.sql import functions as F

    from legible.llm.near import _perhaps

    ids = spark.range(-500, 500).selectExpr("if(id = 7, null, id) AS rep")
    test = _perhaps(ids, "rep")
    rows = spark.range(-5000, 5000).selectExpr("if(id = 8, null, id) AS x").filter(test(F.col("x"))).collect()
    kept = {r["x"] for r in rows}
    assert {None, *range(-500, 500)} - {7, 8} <= kept and len(kept) < 1100


def test_linked_sets_share_a_signature_and_small_projections_do_not_sign():
    import numpy as np
    from legible.llm.near import Bands, signatures

    rnd = np.random.default_rng(3)
    for percent in (80, 85):
        bands = Bands(percent)
        for n in [*range(1, 80), 200, 333, 700] * 3:
            pool = rnd.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
            gone = int(rnd.integers(0, n * (100 - percent) // (100 + percent) + 1))  # as many others come in their place
            s, t = np.unique(pool[:n]), np.unique(pool[gone:n + gone])
            both, least = len(np.intersect1d(s, t)), n * percent // 100
            assert 100 * both >= percent * (2 * n - both)
            assert len(np.intersect1d(signatures(s, bands), signatures(t, bands)))
            part = s[:max(1, -(-len(s) * percent // 100))]                           # the smallest set that can link, in one corner
            assert least <= len(part) and len(np.intersect1d(signatures(s, bands), signatures(part, bands)))

    # sets that have a fiftieth of their shingles in common share few signatures (989 when single shingles signed)
    met, bands = 0, Bands(80)
    for n in (250, 600, 1500, 3000):
        rnd = np.random.default_rng(3)
        for _ in range(10):
            common = rnd.integers(0, 1 << 64, n // 50, dtype=np.uint64)
            sets = [np.unique(np.concatenate([common, rnd.integers(0, 1 << 64, n - n // 50, dtype=np.uint64)])) for _ in range(20)]
            seen = [set(signatures(x, bands).tolist()) for x in sets]
            met += sum(len(a & b) for i, a in enumerate(seen) for b in seen[:i])
    assert met < 750
