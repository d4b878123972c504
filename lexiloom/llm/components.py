"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.scratch import materialize, remove


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """True if each node has one edge to a smaller one, and that one has none: then no step changes anything."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    centres = edges.select(F.col("v").alias("centre")).distinct()
    return n == nodes and edges.join(centres, F.col("u") == F.col("centre"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have an edge in `edges` (a, b); a component is named by its smallest node.

    Loops and repeated edges don't matter; an empty table gives an empty result. Each round is written, in as many tasks as
    adaptive execution finds for its size, and the number of rounds grows with the logarithm of the longest chain.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _are_stars(now):
        new = materialize(_small_star(_large_star(now)), "edges")
        remove(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
