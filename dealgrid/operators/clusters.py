"""Groups from links: every node's component, by the smallest label it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealgrid.session import cut_lineage


def components(links: DataFrame, name: str = "clusters") -> DataFrame:
    """(node, component) for all nodes of undirected links (a, b); the component is its smallest node.

    Each round takes the smallest label next to a node, folded on the map side, and then the label of that label, so chains halve. A round is
    written to the shared folder. Links to oneself and nulls count for nothing.
    """
    links = links.select("a", "b").filter(F.col("a") != F.col("b"))
    links = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), name)
    while True:
        next_to = links.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        lower = labels.join(next_to, "node").select("node", "component", F.least("component", "_near").alias("_low"))
        jump = labels.select(F.col("node").alias("_low"), F.col("component").alias("_far"))
        found = cut_lineage(lower.join(jump, "_low").select("node", F.least("_low", "_far").alias("component"), (F.least("_low", "_far") != F.col("component")).alias("_moved")), name)
        labels = found.select("node", "component")
        if found.filter("_moved").isEmpty():
            return labels
