"""Connected components of a graph given by its edges, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the smallest node reachable, the node itself included.

    Every round ties a node's neighbours to the smallest of them, first the larger, then the smaller ones; the number of
    rounds grows with the logarithm of the longest path. Minima are aggregated before the shuffle, written, and joined back
    on the node, so that a node with very many neighbours is a skewed join (which Spark splits), not a group in one task.
    """
    pairs = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    before = _state(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-large")
        pairs = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = table(pairs.where("a <> b").distinct(), "cc-edges")
        low = table(pairs.groupBy("a").agg(F.min("b").alias("m")), "cc-small")
        moved = pairs.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        pairs = table(low.select("a", F.col("m").alias("b")).unionByName(moved).distinct(), "cc-edges")
        now = _state(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
