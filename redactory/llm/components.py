"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least node around each node: those above it (large) or those below it (small).

    A large step makes one link of each; a small step can make the same link again and again.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    around = both.join(least, "a")
    if large:
        moved = around.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = around.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    moved = moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return moved if large else moved.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link down and links lead to nodes without one: then each is to the least node of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 AND down > 0").count() == 0


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``(node, label)`` for every node with a link; ``label`` is the least node that links reach.

    ``links`` has two columns of one ordered type. Each step ends in a table of
    the shared folder; the number of steps grows with the logarithm of the
    longest chain, and links that are stars already take none.
    """
    a, b = links.columns
    edges = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    step, edges = 0, scratch.keep(edges, f"{name}-0")
    while not _settled(edges):
        step += 1
        edges = scratch.keep(_star(_star(edges, True), False), f"{name}-{step}")
        if step > 1:
            scratch.drop(f"{name}-{step - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
