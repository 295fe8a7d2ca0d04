"""Connected components by alternating stars, every step a durable table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour at most and none that has a lesser one itself; then all is done."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("b", F.lit(0), F.lit(1)))
    per = ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not per.agg(F.max((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))).first()[0]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Joins each node's neighbours to the least of them: the larger neighbours, or itself and the smaller ones. edges, a stored table, is used up.

    The least neighbours are pre-aggregated and written before the join, so that both of its sides are plain exchanges,
    of which Spark can split the partition of a node with very many neighbours.
    """
    seen = edges.union(edges.select(F.col("b"), F.col("a"))) if large else edges
    seen = seen.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = materialize(seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
    joined = seen.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w"), F.col("m")))
    out = out.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Large stars give no more edges than there were; small ones, which follow, remove the repeated.
    out = materialize(out if large else out.distinct(), "edges")
    discard(edges, least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node reachable.

    Large and small stars alternate until only stars are left; the number of rounds grows with the logarithm of the
    longest path. Edges from a node to itself or with a null end don't count; an empty table gives an empty one.
    """
    own = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    own = materialize(own, "edges")
    while not _are_stars(own):
        own = _star(_star(own, True), False)
    nodes = own.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(own.select(F.col("b"), F.col("b")).distinct())
