"""Operator 9, sharding by a hierarchical weighted hash tree (DataFrame functions only).

Each document descends region, rack and shard: at every level each child makes a draw from the document's key and the child's name,
-ln(u) / weight, and the smallest draw wins, so children get rows in proportion to their weights. A subtree whose weight grows can only
gain rows and others only lose rows to it, so a new shard in a region of its own takes rows only into itself.

A null doc_id counts as an empty key, rows with equal doc_id share a shard, and a null text has size 1 and the CRC-32 of no bytes. A very
long text is one row like any other, and an empty table gives no rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def default_tree(shards: int = 8) -> list[Shard]:
    """Four shards a region, two a rack; the shards after the eighth get a region each, so that the tree above them never changes weight."""
    return [Shard(k // 4, k // 2, k) if k < 8 else Shard(k - 6, k - 4, k) for k in range(shards)]


def _draw(key: str, name: str, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.col(key), F.lit("|" + name)).cast("binary")), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(float(weight))


def _pick(key: str, children: list[tuple[int, str, float]]) -> Column:
    """The child with the smallest draw; ties go to the smaller number."""
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.array_min(F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(k).alias("k")) for k, n, w in children]))["k"]


def descend(df: DataFrame, tree: list[Shard], out: str, key: str = "__key") -> DataFrame:
    """Add the column `out` with the shard of each row's key."""
    weight: dict[tuple, float] = {}
    for s in tree:
        for level in ((s.region,), (s.region, s.rack), (s.region, s.rack, s.shard)):
            weight[level] = weight.get(level, 0.0) + s.weight
    name = lambda level: "/".join(map(str, level))
    at = df.withColumn("__region", _pick(key, [(n[0], name(n), w) for n, w in sorted(weight.items()) if len(n) == 1]))
    for col, parent, depth in (("__rack", "__region", 2), (out, "__rack", 3)):
        choice = None
        for p in sorted({n[depth - 2] for n in weight if len(n) == depth}):
            pick = _pick(key, [(n[-1], name(n), w) for n, w in sorted(weight.items()) if len(n) == depth and n[depth - 2] == p])
            choice = F.when(F.col(parent) == p, pick) if choice is None else choice.when(F.col(parent) == p, pick)
        at = at.withColumn(col, choice)
    return at.drop("__region", "__rack")


def shard_documents(docs: DataFrame, tree: list[Shard] | None = None, grown: list[Shard] | None = None, bucket_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row. Slots are numbered in (shard, hash bucket), so no task holds
    a whole shard; a bucket has about bucket_rows rows, whatever the table's size, and the buckets' counts give each its first slot."""
    tree = tree or default_tree(8)
    grown = grown or default_tree(len(tree) + 1)
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__key"))
    rows = descend(descend(rows, tree, "shard"), grown, "grown_shard")
    # rows that repeat an id, as null ones do, are spread by their text and input partition too
    rows = rows.withColumn("mark", F.xxhash64("__key", "text_crc32", F.spark_partition_id())).drop("__key")
    table = written(rows, "shards")
    buckets = 16 + table.count() // (bucket_rows * len(tree))
    table = table.withColumn("bucket", F.pmod("mark", F.lit(buckets)).cast("int")).drop("mark")
    counts = table.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    firsts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return table.withColumn("rank", rank).join(firsts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
