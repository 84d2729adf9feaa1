"""Connected components of a link table by alternating large-star and small-star steps, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node (large: those above it; small: those below, and itself) on its least one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(both.select("v", "u"))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Every upper end has one lower end, which is no upper end itself."""
    n, uppers = edges.agg(F.count("*"), F.count_distinct("a")).first()
    return n == uppers and edges.select(F.col("b").alias("x")).join(edges.select(F.col("a").alias("x")), "x", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected links (a, b); the root is the component's least node.

    Each round is written to the shared folder. Rounds end when the links are stars; a path of n nodes takes some log n.
    """
    edges = materialise(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars(edges):
        edges = materialise(_star(_star(edges, True), False), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
