"""Connected components of a graph given by its edges, by large-star and small-star.

Each round sends every node's larger neighbours to its smallest one, then
every node and its smaller neighbours to the smallest of them, until nothing
changes; every edge then joins a node to the smallest of its component.  Joins
on a node with many edges are left to the sort-merge join that adaptive
execution can split; nothing is collected but a sum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import materialise


def _least(edges: DataFrame, both: bool) -> DataFrame:
    """Each node's edges with the least of its neighbours: of all, or of the smaller ones."""
    directed = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = directed.groupBy("u").agg(F.min("v").alias("m"))
    return directed.join(least.hint("shuffle_merge"), "u")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v), the component by its smallest node.

    Loops, repeated edges and both directions may occur.  No edges: no rows.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (now := _digest(edges)) != before:
        before = now
        large = _least(edges, True).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialise(large, "large-star")
        small = _least(large, False)
        linked = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = materialise(linked.distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
