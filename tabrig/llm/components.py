"""Connected components by repeated contraction, every round a pair of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _shuffled(x: Column) -> Column:
    """A one-to-one map of longs that mixes their order (shifts and exclusive ors), so
    that chains of ascending numbers contract as fast as any others."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label`` for every node of an edge list of longs: nodes have equal
    labels if a path joins them. In each round a node is replaced by the least of itself
    and its neighbours; the labels follow from the rounds' replacements. Nodes without
    edges have no row; null ends are ignored."""
    start = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    x = start.select(_shuffled(F.col("u")).alias("u"), _shuffled(F.col("v")).alias("v"))
    both = x.union(x.select("v", "u")).distinct()
    names = start.select(F.col("u").alias("node")).union(start.select("v")).distinct().select("node", _shuffled(F.col("node")).alias("label"))
    labels = materialise(names, "component-nodes")
    edges = materialise(both, "component-edges")
    while not edges.isEmpty():
        parents = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p"))
        parents = materialise(parents, "component-parents")
        left = parents.select("u", F.col("p").alias("pu"))
        right = parents.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = edges.join(left, "u").join(right, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        edges = materialise(edges.distinct(), "component-edges")
        labels = labels.join(parents.select(F.col("u").alias("label"), "p"), "label", "left")
        labels = materialise(labels.select("node", F.coalesce("p", "label").alias("label")), "component-labels")
    return labels
