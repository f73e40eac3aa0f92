"""Property tests (hypothesis): rewriting forms agree with a plain Python model of the semantics."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from legible.operators import rewrite as R

IDENT = re.compile(r"[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+")
WORDS = st.sampled_from(["a", "b", "ab", "a1", "$a", "x_y", "é", "de", "of", "if"])
SEPS = st.sampled_from([" ", ".", "(", ")", ", ", "\n", "é", "-", ""])


def model(text, mapping):
    return "".join(mapping.get(t, t) for t in IDENT.findall(text))


texts = st.lists(st.tuples(WORDS, SEPS), min_size=0, max_size=12).map(lambda xs: "".join(w + s for w, s in xs))
maps = st.dictionaries(st.sampled_from(["a", "b", "ab", "a1", "de", "if"]),
                       st.sampled_from(["A", "beta", "b", "a", "x$y", "z\\1"]), max_size=4)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=1, max_size=5), maps)
def test_rewrite_forms_agree_with_model(spark, docs, mapping):
    files = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    rules = spark.createDataFrame(list(mapping.items()) or [], "old_key string, new_name string")
    want = {i: model(t, mapping) for i, t in enumerate(docs)}
    small = {r.doc_id: r.new_text for r in R.rewrite_tokens(files, rules).collect()}
    big = {r.doc_id: r.new_text for r in R.rewrite_tokens_lookup(files, rules).collect()}
    assert small == want and big == want
    occ = R.token_occurrences(files, "[a-z]{1,2}[0-9]?", "simple")
    m = rules.selectExpr("'simple' AS kind", "old_key", "new_name")
    spliced = {r.doc_id: r.new_text for r in R.rewrite_occurrences(files, occ, m).collect()}
    short = {k: v for k, v in mapping.items() if re.fullmatch(r"[a-z]{1,2}[0-9]?", k)}
    assert spliced == {i: model(t, short) for i, t in enumerate(docs)}
