"""Connected components of an edge table by alternating large and small stars.

Each round joins and groups edges by node, so work spreads by key with partial aggregation; between rounds the edges are checkpointed to
the shared folder. Rounds grow with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written


#: So many edges at most may be broadcast (16 bytes each).
SMALL = 1_000_000


def _least(pairs: DataFrame, few: bool) -> DataFrame:
    """pairs(u, v) beside m, the least of u and its neighbours. Few pairs need no shuffle of a star's edges to its centre."""
    m = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(F.broadcast(m) if few else written(m, "least"), "u")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs -> (node, component), component being the least node reachable. Nodes without edges don't appear.

    Raises RuntimeError if `rounds` don't suffice, rather than return part of a component."""
    shared_dir(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()
    seen, few = None, now.count() <= SMALL
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: every node and its smaller neighbours hang from the least of them
        small = _least(large, few).select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        now = small.checkpoint()
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
