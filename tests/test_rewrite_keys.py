from legible.operators import rewrite as R


def test_null_and_repeated_keys_at_every_size(spark):
    rows = [(None, "a0 x a1"), (1, "a2 y"), (1, "z a3 a3"), (2, None), (2, ""), (None, "a0 x a1"), (3, "none here")]
    files = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(None, "b0 x b1", 2), (1, "b2 y", 1), (1, "z b3 b3", 2), (2, None, 0), (2, "", 0), (None, "b0 x b1", 2),
                   (3, "none here", 0)], key=repr)
    for n in (10, R.MAP_LITERAL_MAX + 50):
        rules = spark.createDataFrame([("a%d" % k, "b%d" % k) for k in range(n)], "old_key string, new_name string")
        got = R.rewrite_tokens(files, rules)
        assert got.columns == ["doc_id", "text", "new_text", "n_replacements"]
        assert sorted(((r.doc_id, r.new_text, r.n_replacements) for r in got.collect()), key=repr) == want, n


def test_frequent_keys_come_without_whole_partitions(spark, monkeypatch):
    """The most frequent keys are chosen by a histogram: no sort with a limit, which sends as many rows from every partition."""
    from legible.operators import lookup
    monkeypatch.setattr(lookup, "LOOKUP_MAX_ROWS", 100)
    n, sent = 4000, []
    rules = spark.range(n, numPartitions=40).selectExpr("concat('k', id) AS old_key", "concat('n', id) AS new_name",
                                                        "if(id < 50, 1000 + id, 1) AS _rows")
    collect = type(rules).collect

    def counted(df):
        assert "TakeOrdered" not in df._jdf.queryExecution().executedPlan().toString()
        rows = collect(df)
        sent.append(len(rows))
        return rows
    monkeypatch.setattr(type(rules), "collect", counted)
    found = lookup.frequent_lookup(rules, "old_key", "new_name")
    monkeypatch.undo()
    assert not found.empty and sum(sent) < 400
    got = rules.select("old_key", "_rows", found(rules["old_key"]).alias("v")).filter("v is not null").collect()
    assert {"k%d" % i for i in range(50)} <= {r.old_key for r in got} and len(got) <= 100
    assert all(r.v == "n" + r.old_key[1:] for r in got)


def test_gaps_around_looked_up_identifiers(spark):
    rows = [(1, "a0"), (2, " a0"), (3, "a0 "), (4, "..a1--a2\n\na0éa1"), (5, "?!"), (6, "a1 zz a999"), (7, "\U0001F600a0\U0001F600")]
    files = spark.createDataFrame(rows, "doc_id long, text string")
    rules = spark.createDataFrame([("a%d" % k, "b$%d\\" % k) for k in range(R.MAP_LITERAL_MAX + 1)], "old_key string, new_name string")
    import re
    want = [(i, re.sub(r"(?<![\w$])a([012])(?![\w$])", lambda m: "b$%s\\" % m[1], t, flags=re.A),
             len(re.findall(r"(?<![\w$])a[012](?![\w$])", t, flags=re.A))) for i, t in rows]
    assert sorted((r.doc_id, r.new_text, r.n_replacements) for r in R.rewrite_tokens(files, rules).collect()) == want
