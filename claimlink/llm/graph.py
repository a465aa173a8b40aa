"""Connected components of an edge list, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlink.llm.shared import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node that can be reached. Nodes without edges aren't in it.

    Each round every node takes the least label among its neighbours' and its own, then the label of that label, so that the
    number of rounds grows with the logarithm of the longest path. Labels stay on the cluster; only a count is read.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    step = materialise(both.groupBy(F.col("a").alias("node")).agg(F.first("a").alias("old"), F.least(F.min("b"), F.first("a")).alias("c")))
    while not step.where("old <> c").isEmpty():
        labels, before = step.select("node", "c"), step
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("c").alias("m"))
        moved = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        of = labels.select(F.col("node").alias("n2"), F.col("c").alias("c2"))
        step = materialise(moved.join(of, moved["c"] == of["n2"], "left").select("node", "old", F.least("c", "c2").alias("c")))
        discard(before)
    discard(both)
    return step.select("node", F.col("c").alias("component"))
