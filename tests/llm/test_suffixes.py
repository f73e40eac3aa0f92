from legible.llm.urls import domain_of, reputation, suffix_of
from pyspark.sql import functions as F


def test_suffixes_of_several_labels(spark):
    hosts = ["a.x.co.uk", "x.co.uk", "co.uk", "y.com.au", "a.b.example.org", "example.org", "org", "", "notco.uk"]
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(
        domain_of(F.col("h")), suffix_of(F.col("h"))).collect()]
    assert got == [("x.co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com.au", "com.au"), ("example.org", "org"),
                   ("example.org", "org"), ("org", "org"), ("", ""), ("notco.uk", "uk")]


def test_unlabelled_host_inherits_from_its_own_domain_only(spark):
    rows = [("w%d.bad.co.uk" % k, 1) for k in range(6) for _ in range(30)] + [("w%d.good.co.uk" % k, 0) for k in range(6) for _ in range(30)]
    rows += [("new.bad.co.uk", None), ("new.good.co.uk", None)]
    rate = {r["host"]: r["rate"] for r in reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert rate["new.bad.co.uk"] > 0.7 and rate["new.good.co.uk"] < 0.3
