"""Connected components of a graph of longs by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _least(neighbours: DataFrame) -> DataFrame:
    """The least of each node u and its neighbours v; a partial aggregate, so hot nodes are summed before they move."""
    return neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Links every neighbour above a node to the least of the node and its neighbours (an edge may come more than once). Edges are
    (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.where("v > u").join(_least(both), "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its neighbours below it to the least of them. Edges are (u, v) with u > v."""
    least = _least(edges)
    below = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b), component being the least node that can be reached. Edges from a
    node to itself are ignored. Each round is written to the shared folder; the number of rounds grows with the logarithm
    of the longest path, and running out of them is an error, never a wrong result."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    print_ = _fingerprint(now)
    for _ in range(most_rounds):
        new = materialise(small_star(large_star(now)), name)
        discard(now)
        now, before, print_ = new, print_, _fingerprint(new)
        if print_ == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def _fingerprint(edges: DataFrame) -> tuple:
    """Two sums over an edge set, small enough to compare on the driver; a star set that a round leaves as it is has settled."""
    mix = lambda seed: F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mix(1), mix(2)).first())
