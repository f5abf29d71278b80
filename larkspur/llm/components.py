"""Connected components of a large edge list, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, small


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge touches; edges has long columns a and b.

    Each round, every node joins its smallest neighbour (or stays, if it is smaller itself) and the edges are
    rewritten between those. Node ids should be well mixed (hashes): a round then leaves a fraction of the nodes,
    so rounds grow with the logarithm of the longest path. Minima are partial aggregates, so a node with very many
    neighbours is never gathered in one task. Self-loops and repeated edges are harmless; no edges: no rows.
    """
    both = edges.select("a", "b").where("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    first = True
    while not both.isEmpty():
        parent = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        if first:
            labels, first = parent.select(F.col("a").alias("node"), F.col("p").alias("root")), False
        else:
            labels = labels.join(small(parent), labels["root"] == parent["a"], "left").select("node", F.coalesce("p", "root").alias("root"))
            labels = materialize(labels, "labels")
        left = small(parent.select("a", F.col("p").alias("pa")))
        right = small(parent.select(F.col("a").alias("b"), F.col("p").alias("pb")))
        both = both.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct()
        both = materialize(both, "edges")
    return labels
