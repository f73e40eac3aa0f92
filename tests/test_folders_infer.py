"""Folder conflicts, reply parsing, inference with retries."""

from pyspark.sql import functions as F

from legible.operators import folders as FO
from legible.operators import infer as I


def test_conflicts_suffix_and_cross_base(spark):
    files = spark.createDataFrame([
        ("com/x/a", "UserStore"), ("com/x/b", "UserView"), ("com/x/c", "Misc"), ("com/x/user", "Keep"),
        ("com/x/d", "User2Thing"), ("org/y/e", "Lib")], "folder string, name string")
    cands = FO.suspicious_folders(files)
    assert sorted(r.folder for r in cands.collect()) == ["com/x/a", "com/x/b", "com/x/c", "com/x/d"]
    seg = FO.heuristic_segment(cands, files)
    assert {r.folder: r.segment for r in seg.collect()} == {
        "com/x/a": "userstore", "com/x/b": "userview", "com/x/c": "misc", "com/x/d": "user2thing"}
    seg2 = spark.createDataFrame([("com/x/a", "com/x", "user"), ("com/x/b", "com/x", "user2"), ("com/x/c", "com/x", "user")],
                                 "folder string, parent string, segment string")
    plan = {r.folder: r.target for r in FO.resolve_name_conflicts(seg2, FO.existing_folders(files)).collect()}
    # greedy in path order: a -> user is taken (existing) -> user2; b wants user2 (taken by a) -> user22;
    # c -> user3
    assert plan == {"com/x/a": "user2", "com/x/b": "user22", "com/x/c": "user3"}


def test_parse_replies(spark):
    replies = spark.createDataFrame([
        (1, '[{"kind":"var","old":"a","new":"b"}]'),
        (2, '{"renames":[{"type":"class","from":"X","to":"Y"}]}'),
        (3, 'Sure:\n```json\n{"items":[{"kind":"field","key":"f","value":"g","reason":"r"},{"kind":"var","old":"q"}]}\n```'),
        (4, "not json at all"), (5, "")], "id int, reply string")
    got = sorted((r.id, r.kind, r.old, r.new) for r in I.parse_suggestions(replies, ["id"]).collect())
    assert got == [(1, "var", "a", "b"), (2, "class", "X", "Y"), (3, "field", "f", "g")]
    seg = I.parse_folder_segments(spark.createDataFrame([(1, '{"/p/a":{"newSegment":"auth"}}')], "id int, reply string"),
                                  ["id"]).collect()
    assert [(r.folder, r.new_segment) for r in seg] == [("/p/a", "auth")]


def test_batch_infer_retry(spark):
    prompts = spark.createDataFrame([(i, "methodName: m%d\nxx" % i) for i in range(12)], "b int, prompt string")
    flaky = I.FlakyProvider(I.EchoRenameProvider(), fail_mod=3)
    pol = I.RetryPolicy(tries=1, sleep=False)
    first_df = I.batch_infer(prompts, flaky, ["b"], concurrency=3, policy=pol)
    first = first_df.collect()
    failed = [r for r in first if r.error]
    assert failed and all("503" in r.error for r in failed)
    fixed_df = I.retry_failed(first_df, prompts, I.EchoRenameProvider(), ["b"], policy=pol)
    fixed = fixed_df.collect()
    assert len(fixed) == 12 and all(r.error is None for r in fixed)
    parsed = I.parse_suggestions(fixed_df, ["b"]).collect()
    assert sorted(r.new for r in parsed)[0].startswith("handleM")


def test_align_by_position(spark):
    inputs = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "c")], "batch int, pos int, x string")
    outs = spark.createDataFrame([(0, 0, "A"), (0, 1, "B"), (0, 5, "extra")], "batch int, pos int, doc string")
    got = sorted((r.x, r.doc) for r in I.align_by_position(inputs, outs, ["batch"]).collect())
    assert got == [("a", "A"), ("b", "B"), ("c", "")]


def test_retry_policy_waits(monkeypatch):
    import legible.operators.infer as INF
    waits = []
    monkeypatch.setattr(INF.time, "sleep", lambda s: waits.append(s))

    class Busy(Exception):
        retry_after = 2.5

    calls = {"n": 0}

    def provider(prompts):
        calls["n"] += 1
        if calls["n"] == 1:
            raise RuntimeError("429 Too Many Requests")
        if calls["n"] == 2:
            raise Busy("503 busy")
        return ["ok"]
    reply, err, attempts = INF._call_with_retry(provider, "p", INF.RetryPolicy(tries=4, jitter_ms=0))
    assert (reply, err, attempts) == ("ok", None, 3)
    assert waits[0] >= 1.5 and waits[1] == 2.5
    reply, err, attempts = INF._call_with_retry(lambda p: (_ for _ in ()).throw(ValueError("bad request")), "p",
                                                INF.RetryPolicy(tries=4))
    assert reply is None and attempts == 1 and "bad request" in err       # not transient: no retry
