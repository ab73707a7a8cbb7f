"""Connected components of a graph of 64-bit node ids, as Spark jobs.

Every node points at the smallest neighbour it knows of, and rounds of large
and small stars shorten the paths: each links a node's neighbours to the
smallest of them, so a chain of any length collapses in a logarithmic number of
rounds. A node's neighbours are folded by aggregates and joins, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundledger.llm.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest neighbour or itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node but the roots has one edge, which leads to a root."""
    ends = edges.select(F.col("b").alias("a")).distinct()
    if not edges.join(ends, "a", "left_semi").isEmpty():
        return False
    return edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) of edges ``a``, ``b``.

    Nodes of self-loops alone and nodes without edges are not returned. Nodes
    must not be NULL.
    """
    now = edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    now = stored(now, "edges")
    while not _stars(now):
        now = stored(_small_star(_large_star(now)), "edges")
    # Every edge now leads from a node to the root of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
