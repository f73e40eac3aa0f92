import base64

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from brute import crc, sha
from legible.llm import bpe, tokens
from legible.llm.queries import queries
from llm_edges import DIR, EDGE
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_op2_equals_library(spark, documents, library):
    got = {r[0]: tuple(r)[1:] for r in queries()["op2_byte_bpe"](spark, DIR).collect()}
    want = {}
    for i, t in documents:
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(t))
    assert got == want


def test_op2_edges(spark, edge, nothing, library):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.decode(bpe.encode(edge, path, P.PATTERN), path).collect()
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in EDGE), key=repr)
    assert sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in rows), key=repr) == want
    assert bpe.decode(bpe.encode(nothing, path, P.PATTERN), path).count() == 0


def test_prefix_table_appends_and_edits(library):
    import random
    rnd = random.Random(3)
    vocab = bpe.Vocabulary(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    for _ in range(100):
        data = bytes(rnd.choice(b"the ation ing ed \xc3\xa9") for _ in range(rnd.randint(1, 60)))
        cut, new = rnd.randint(0, len(data)), bytes(rnd.choice(b"thean ") for _ in range(rnd.randint(0, 6)))
        t = bpe.PrefixTable(vocab, data[:cut])
        t.append(data[cut:])
        assert t.ids() == library._encode_single_piece(data)
        long, end = bpe.PrefixTable(vocab, data * 20), rnd.randint(cut, len(data))
        long.replace(cut, end, new)
        assert long.ids() == library._encode_single_piece((data * 20)[:cut] + new + (data * 20)[end:])


def test_op3_equals_library(spark, documents, other):
    got = [tuple(r) for r in queries()["op3_token_files"](spark, DIR).orderBy("doc_id").collect()]
    want, start = [], 0
    for i, t in documents:
        ids = [*other.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_op3_edges_and_selective_read(spark, edge, nothing, other):
    path = tokens.new_token_path(spark)
    tokens.write_tokens(edge, path, P.path("byte_bpe_50k.json"))
    rows = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    texts = {i: t for i, t in EDGE}
    for r in rows:
        assert list(r["ids"]) == [*other.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
    some = tokens.read_tokens(spark, path, "doc_id", "start", where="doc_id = 8")
    plan = some._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,8)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    path = tokens.new_token_path(spark)
    tokens.write_tokens(nothing, path, P.path("byte_bpe_50k.json"))
    assert tokens.read_tokens(spark, path).count() == 0


def test_round_trip_leaves_no_units_in_its_processes(spark):
    """Tasks go round an executor's idle processes: what each remembers must go with the task."""
    texts = [("a%d qzx%d Wort %d ähm" % (i, i, i)) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    path = P.path("byte_bpe_50k.tiktoken")
    assert df.count() == bpe.round_trip(df, path, P.PATTERN).filter("decodes").count()

    def remembered(batches):
        from legible.llm import units
        for b in batches:
            n = sum(b"qzx" in u for _, _, m in units._MEMOS for u in [*m._young, *m._old])
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(b), pa.int64())], ["n"])
    assert {r.n for r in df.select("doc_id").mapInArrow(remembered, "n bigint").collect()} == {0}
