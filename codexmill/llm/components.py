"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(rows: DataFrame) -> DataFrame:
    """a, m: the smallest b of each a. Written, so that the join with it is one of two plain exchanges, whose large parts are split."""
    return common.scratch(rows.groupBy("a").agg(F.min("b").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    least = _least(edges)
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 OR (up = 1 AND n > 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """For edges of columns a, b: a row (node, root) per node, root being the component's smallest node.

    Self-loops, repeated edges and edges with a null end are left out. Each round is written to the
    shared folder; the number of rounds is logarithmic in a component's diameter. Nothing but a yes or no
    comes to the driver.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.scratch(now, "edges")
    while not _are_stars(now):
        now = common.scratch(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
