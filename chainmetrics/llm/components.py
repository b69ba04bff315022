"""Connected components by contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, comp), one row a node, of a type that has an order; edges (a, b) between nodes.

    Returns labels in which comps that edges join have become one, named by the smallest comp in it.
    Each round hangs every comp on its smallest neighbour and follows the pointers twice; the graph of
    comps shrinks until no edge is left. Nulls and self loops are ignored; no edges: labels as given.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    while True:
        left, right = labels.select(F.col("node").alias("a"), F.col("comp").alias("u")), labels.select(F.col("node").alias("b"), F.col("comp").alias("v"))
        between = materialize(edges.join(left, "a").join(right, "b").where("u <> v").select("u", "v").distinct())
        if between.isEmpty():
            return labels
        both = between.union(between.select("v", "u"))
        parent = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        parent = materialize(parent.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p")))
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        parent = parent.join(up, "p", "left").select(F.col("u").alias("comp"), F.coalesce("q", "p").alias("root"))
        labels = materialize(labels.join(parent, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
