from legible.operators import folders as FO


def test_folder_is_named_from_all_its_names(spark):
    names = ["Alpha%02dx alpha" % k for k in range(40)] + ["Omega omega zulu%02d zulu" % k for k in range(60)]
    files = spark.createDataFrame([("p/a", n) for n in names], "folder string, name string")
    cands = spark.createDataFrame([("p/a", "p")], "folder string, parent string")
    assert [r.segment for r in FO.heuristic_segment(cands, files).collect()] == ["omega"]
    assert [r.segment for r in FO.heuristic_segment(cands, files, FO.NAMES_PER_FOLDER).collect()] == ["alpha"]
