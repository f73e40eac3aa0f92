from legible.llm import decontam


def test_one_block_of_items_lives_at_a_time(spark, monkeypatch):
    items = [(k, " ".join("w%d_%d" % (k, j) for j in range(12))) for k in range(9)]
    docs = [(d, " ".join(t for k, t in items if k % 3 == d) + " own text") for d in range(3)] + [(None, None), (3, "")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    send = spark.sparkContext.broadcast
    for block, blocks in ((10 ** 6, 1), (30, 5)):
        monkeypatch.setattr(decontam, "BLOCK", block)
        assert len(list(decontam._blocks(b, "item_id", "text"))) == blocks
        sent, gone = [], []

        def broadcast(value):
            shared = send(value)
            end = shared.destroy
            shared.destroy = lambda *x: (gone.append(1), end(*x))
            sent.append(1)
            return shared

        monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
        out = decontam.contained_items(a, b)
        assert (len(sent), len(sent) - len(gone)) == (blocks, 1)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        got = {r["doc_id"]: (list(r["item_ids"]), r["contaminated"]) for r in out.collect()}
        assert got == {0: ([0, 3, 6], True), 1: ([1, 4, 7], True), 2: ([2, 5, 8], True), None: ([], False), 3: ([], False)}
