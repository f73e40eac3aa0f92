"""Connected components of a link table, as joins and minimum aggregates (nothing is collected)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legible.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``: ``label`` is the smallest node that can be reached.

    Every round a node takes the smallest label among itself and its neighbours, then the label of its label
    (pointer jumping), so a chain shrinks geometrically.  Tables of a round are written before the next one.
    An empty table gives an empty result."""
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .filter("a <> b").distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_near"))
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        at = labels.select(F.col("node").alias("_at"), F.col("label").alias("_far"))
        labels = stage(step.join(at, step["_new"] == at["_at"]).select(
            "node", F.least("_new", "_far").alias("label"), (F.least("_new", "_far") != F.col("_old")).alias("_changed")), "labels")
        if labels.filter("_changed").limit(1).count() == 0:
            return labels.select("node", "label")
        labels = labels.select("node", "label")
