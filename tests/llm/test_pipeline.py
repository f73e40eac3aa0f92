import base64

import corpus_pipeline as C
import public_tokenizers as P
import tiktoken
from brute import components, shingle_set, words
from llm_edges import DIR
from test_dedup import deleted


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(DIR + "/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    after = {}
    for name, f in C.STAGES:
        docs = C.stage(f(spark, docs, DIR), name)
        rows = docs.collect()
        after[name] = {r["doc_id"]: r for r in rows}
        assert len(rows) == len(after[name])
        assert docs.columns == columns or name == "byte_bpe"

    kept = after["quality_rules"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(DIR + "/labels.parquet").collect()}
    assert all(before[i] == r for i, r in kept.items())
    assert all(len(words(r["text"])) >= 20 for r in kept.values())
    assert sum(labels.get(i) == 0 for i in kept) <= 4                   # few texts: EM is held to labels at sf0.01

    plain = {i: (ls, gone) for i, ls, gone in deleted(sorted((i, r["text"]) for i, r in kept.items()))}
    for i, (ls, gone) in plain.items():
        left = [x for k, x in enumerate(ls) if k not in gone]
        if i in after["line_dedup"]:
            now = [tuple(words(x)) for x in after["line_dedup"][i]["text"].split("\n") if words(x)]
            assert set(left) <= set(now) and set(now) <= set(ls)
            assert after["line_dedup"][i]["n_chars"] == len(after["line_dedup"][i]["text"])
        else:
            assert not left

    groups = components(sorted((i, r["text"]) for i, r in after["line_dedup"].items()), 5, 80)
    assert set(after["ngram_jaccard"]) == {i for i, _, c in groups if i == c}

    items = [shingle_set(r["text"], 5) for r in spark.read.parquet(DIR + "/benchmark.parquet").collect()]
    clean = {i for i, r in after["ngram_jaccard"].items()
             if not any(q and 100 * len(q & shingle_set(r["text"], 5)) >= 80 * len(q) for q in items)}
    assert set(after["decontamination"]) == clean

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(C.RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(after["byte_bpe"]) == clean
    for i, r in after["byte_bpe"].items():
        assert r["decodes"] and list(r["ids"]) == library.encode_ordinary(after["decontamination"][i]["text"])


def test_empty_and_null_documents(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", None, None, 3)]):
        docs = spark.createDataFrame(rows, kind)
        for name, f in C.STAGES:
            docs = C.stage(f(spark, docs, DIR), name)
        assert docs.count() == 0
    same = " ".join("word%d" % k for k in range(40)) + "."
    docs = spark.createDataFrame([(5, same, "en", "s", 1), (5, same, "en", "s", 1), (None, same + " x", None, None, None)], kind)
    for name, f in C.STAGES:
        docs = C.stage(f(spark, docs, DIR), name)
    assert {r["doc_id"] for r in docs.collect()} == {5}
