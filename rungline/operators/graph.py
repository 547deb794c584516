"""Graph operators by frontier: each round is a join of the frontier with the edges and an anti join with what was seen.

Between rounds the state is checkpointed once to the session's checkpoint folder, so lineage stays short and a lost executor costs one
read. Edges never come to the driver; a round's row count does."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ready(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        base = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-rungline-"))


def kept(df: DataFrame) -> DataFrame:
    """df as rows in the checkpoint folder: what is read many times is made once, and a lost executor costs one read."""
    _ready(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """kept, in Parquet files: a reader takes only the columns that it needs, and Spark sees how large they are.

    A checkpoint is planned with the size that was guessed for its source, and what Python parses out of a small table can be a thousand times
    as large: joins would broadcast it, through the driver. Not for whole files in a column, which Parquet's reader takes by the thousand."""
    _ready(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, seeds: DataFrame, rounds: int = 1000) -> DataFrame:
    """node, depth for every node reachable from seeds(node) over edges(src, dst); seeds have depth 0. Raises if `rounds` don't suffice."""
    _ready(edges)
    edges = edges.select("src", "dst").distinct().checkpoint()
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    for depth in range(1, rounds + 1):
        front = seen.where(F.col("depth") == depth - 1)
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(new.withColumn("depth", F.lit(depth))).checkpoint()
        if seen.where(F.col("depth") == depth).isEmpty():
            return seen
    raise RuntimeError(f"nodes are still found after {rounds} rounds")


def nearest_sink(edges: DataFrame, start: DataFrame, sinks: DataFrame, hops: int = 12) -> DataFrame:
    """start, sink, hops, chain: the best-ranked sink at the least depth, and the nodes from the first to it. start(start, node),
    sinks(node, rank); ties go to the smaller sink, then to the smaller next node.

    A start that is a sink itself is its own, at 0 hops. The search goes backward from the sinks: a node at a distance takes the best of
    those that its next nodes at one less have, so each node is settled once, whatever the number of starts. `hops` is the search's depth."""
    _ready(edges)
    edges = edges.select("src", "dst").distinct().checkpoint()
    best = F.min(F.struct((-F.col("rank")).alias("r"), F.col("sink"), F.col("chain"))).alias("m")
    done = sinks.groupBy("node").agg(F.max("rank").alias("rank")).select("node", F.col("node").alias("sink"), "rank", F.lit(0).alias("hops"), F.array("node").alias("chain")).checkpoint()
    for depth in range(1, hops + 1):
        front = done.where(F.col("hops") == depth - 1)
        step = front.join(edges, F.col("node") == F.col("dst")).select(F.col("src").alias("at"), "sink", "rank", "chain").groupBy("at").agg(best)
        step = step.join(done.select(F.col("node").alias("at")), "at", "left_anti").select(F.col("at").alias("node"), F.col("m.sink").alias("sink"), (-F.col("m.r")).alias("rank"), F.lit(depth).alias("hops"), F.concat(F.array("at"), "m.chain").alias("chain"))
        done = done.unionByName(step).checkpoint()
        if done.where(F.col("hops") == depth).isEmpty():
            break
    found = start.select("start", "node").distinct().join(done, "node")
    first = F.min(F.struct("hops", (-F.col("rank")).alias("r"), "sink", "chain")).alias("m")
    return found.groupBy("start").agg(first).select("start", F.col("m.sink").alias("sink"), F.col("m.hops").alias("hops"), F.col("m.chain").alias("chain"))


def forest(tree: DataFrame) -> DataFrame:
    """node, path (the sort keys from the root down to the node) for each row of tree(node, parent, ord, key); ord orders nodes, key siblings.

    A node without a parent, under itself or under one that isn't there is a root. Of nodes on a cycle, or below one, those become roots
    whose ord is the least among all that they hang from, so each appears once. Ancestors are found by doubling: after k rounds every node
    knows what is 2^k above it, so rounds grow with the logarithm of the depth."""
    _ready(tree)
    there = tree.select(F.col("node").alias("parent")).distinct()
    t = tree.join(there.withColumn("__there", F.lit(True)), "parent", "left").withColumn("parent", F.when(F.col("__there") & (F.col("parent") != F.col("node")), F.col("parent"))).drop("__there").checkpoint()
    # who has no end above, and the least ord of all that it hangs from
    now, open_, reach, left = t.select("node", F.col("parent").alias("up"), F.col("ord").alias("least")).checkpoint(), None, 1, 1
    while True:
        more = now.where("up IS NOT NULL").count()
        if more == 0 or (more == open_ and reach >= left):
            break
        if more != open_:
            left = more
        open_, reach = more, reach * 2
        above = now.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("least").alias("__least"))
        now = now.join(above, "up", "left").select("node", F.col("__up").alias("up"), F.least("least", "__least").alias("least")).checkpoint()
    ends = now.where("up IS NOT NULL").select("node", "least")
    t = t.join(ends, "node", "left").withColumn("parent", F.when(F.col("least").isNull() | (F.col("ord") != F.col("least")), F.col("parent"))).drop("least")
    now = t.select("node", F.col("parent").alias("up"), F.array("key").alias("path")).checkpoint()
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("path").alias("__path"))
        now = now.join(above, "up", "left").select("node", F.col("__up").alias("up"), F.when(F.col("__path").isNull(), F.col("path")).otherwise(F.concat("__path", "path")).alias("path")).checkpoint()
    return now.select("node", "path")


def call_trees(edges: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """node, path, level, recursive: every call path from roots(node) over edges(src, dst); a node already on its path is cut and marked.

    Raises if a path without a cycle is longer than `depth`."""
    _ready(edges)
    edges = edges.select("src", "dst").distinct().checkpoint()
    front = roots.select("node", F.array("node").alias("path"), F.lit(0).alias("level"), F.lit(False).alias("recursive")).checkpoint()
    out = front
    for level in range(1, depth + 1):
        # each level is made of the one before alone: a union that is read again in every round doubles its partitions
        at = front.where(~F.col("recursive")).select(F.col("node").alias("src"), "path")
        step = at.join(edges, "src").select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.lit(level).alias("level"), F.array_contains("path", F.col("dst")).alias("recursive"))
        front = step.hint("rebalance").checkpoint()
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise RuntimeError(f"calls are nested deeper than {depth}")
