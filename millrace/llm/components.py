"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b): the smallest node that it reaches.

    Each round every node takes the smallest label among its own and its neighbours', and then the label that its
    label's node has; labels of long chains so shrink by doubling. A round joins edges with labels, where a
    node of many edges is split by the adaptive join, and takes minima with partial sums before the
    shuffle. Tables between rounds lie in the shared folder; the driver sees only counts.
    """
    both = written(edges.where("a <> b").selectExpr("a AS src", "b AS dst").unionAll(edges.where("a <> b").selectExpr("b AS src", "a AS dst")).distinct(), "edges")
    labels = written(both.groupBy("src").agg(F.min("dst").alias("least")).select(F.col("src").alias("node"), F.least("src", "least").alias("label")), "labels")
    while True:
        offered = both.join(labels, both.src == labels.node).select(F.col("dst").alias("node"), "label")
        least = offered.unionAll(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        least = written(least, "labels")
        hop = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(least.join(hop, "label").select("node", F.least("label", "further").alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        labels = after
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
