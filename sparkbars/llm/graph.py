"""Connected components as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: each step hangs the neighbours of a node on the smallest of them, so the
    number of edges never grows and the rounds are logarithmic. Minima are combined before the shuffle, and a node with many
    neighbours is only met in a join, which adaptive execution can split. Each round is written to the shared folder.
    """
    pairs = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        after = scratch.save(small.where("a <> b").distinct())
        changed = after.join(pairs, ["a", "b"], "left_anti").limit(1).count() or pairs.join(after, ["a", "b"], "left_anti").limit(1).count()
        scratch.drop(pairs)
        pairs = after
        if not changed:
            break
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
