"""Connected components by contracting every node into its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), the component being its smallest node.

    A round maps each node to the least of itself and its neighbours and keeps the edges between
    different images; at least half of the nodes of a component vanish, so rounds grow with the
    logarithm of the longest path. Aggregates are combined before the shuffle, and what remains
    is joined by node, so a node with very many edges is no task's work. Self links are allowed.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_from")).agg(F.min("b").alias("_b"))
        least = written(least.select("_from", F.least("_from", "_b").alias("_to")), "images")
        labels = written(
            labels.join(least, F.col("component") == F.col("_from"), "left").select("node", F.coalesce("_to", "component").alias("component")),
            "labels",
        )
        ends = least.select(F.col("_from").alias("_from_b"), F.col("_to").alias("_to_b"))
        moved = edges.join(least, F.col("a") == F.col("_from")).join(ends, F.col("b") == F.col("_from_b"))
        edges = written(moved.select(F.col("_to").alias("a"), F.col("_to_b").alias("b")).where("a <> b").distinct(), "edges")
    return labels
