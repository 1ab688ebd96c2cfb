"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges ``a > b``. Lowest neighbours come from partial aggregates.

    Both sides of the join are files, so a node with very many neighbours is split.
    """
    if large:
        arcs = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    else:
        arcs = edges.toDF("u", "v")
    lowest = cut(arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = arcs.join(lowest, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.union(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return cut(out.filter("a > b").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node ``a`` has one neighbour ``b``, and no ``b`` is an ``a`` as well."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    per_node = roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return per_node.filter("leaf > 1 or (leaf = 1 and centre = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node of the component.

    The edge set shrinks to one star per component. Each step is written to the
    shared folder, so a lost executor costs that step only.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while not _stars(edges):
        edges = _star(_star(edges, large=True), large=False)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
