"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.lineage import cut

#: Rounds after which an unfinished run is an error; the number of rounds grows with the logarithm of the longest path.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v). Each node's least neighbour comes from an aggregate, so no neighbourhood is gathered."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of ``edges(u, v)``; the component is its least node.

    Loops and repeated edges change nothing; edges with a NULL end are left
    out; no edges give no rows. The hot centre of a star is split by AQE's
    skew join, and its least neighbour is found by partial aggregation.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now == mark:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now
    raise RuntimeError("connected components did not settle")
