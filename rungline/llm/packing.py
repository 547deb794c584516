"""Operator 2, best-two-fit packing of documents into sequences of at most `capacity` tokens.

Pieces have at most `capacity` distinct lengths, so the plan is made on counts: a bin is a multiset of lengths, and equal bins are made
many at a time. A bin is filled greedily with the largest lengths that fit; then its smallest piece gives way to the two unpacked pieces
that fill the enlarged gap more tightly, if there are such. The plan has a bounded size (lengths and bin shapes, never documents). The
pieces are then numbered within their length on the executors and each number looks its place up in the plan.

Null text counts as empty: the document is its end id alone. Rows with a null or repeated doc_id are packed like any other. Longer
documents are cut from the back into full pieces; the first piece may be shorter."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bare, written
from .pieces import encoder, runs


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document."""

    def cut(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in runs(texts, 1 << 24):  # the more at once, the fewer chunks are looked up
                for doc, x in zip(names[a:z], enc.ids_many(texts[a:z]), strict=True):
                    ids = memoryview(x + end)
                    n = len(ids) // 4
                    at, k = 0, 0
                    size = n % capacity or capacity
                    while at < n:
                        out.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                        at, k, size = at + size, k + 1, capacity
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_bins(count: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """count[n]: pieces of length n. Returns (lengths of a bin, how many such bins), with every piece in one bin."""
    left = count.astype(np.int64).copy()
    left[0] = 0
    bins: list[tuple[list[int], int]] = []

    def largest(at_most: int) -> int:
        there = np.flatnonzero(left[1 : at_most + 1])
        return int(there[-1]) + 1 if len(there) else 0

    def two(gap: int, over: int) -> tuple[int, int] | None:
        """The two unpacked lengths with the largest sum in (over, gap]."""
        there = np.flatnonzero(left[1 : gap + 1]) + 1
        if not len(there):
            return None
        mate_at = np.searchsorted(there, gap - there, "right") - 1
        mate = np.where(mate_at >= 0, there[mate_at], 0)
        same = (mate == there) & (left[there] < 2)
        mate = np.where(same, np.where(mate_at > 0, there[np.maximum(mate_at - 1, 0)], 0), mate)
        sums = np.where(mate > 0, there + mate, 0)
        best = int(np.argmax(sums))
        return (int(there[best]), int(mate[best])) if sums[best] > over else None

    while first := largest(capacity):
        shape, gap = [first], capacity - first
        left[first] -= 1
        while gap and (x := largest(gap)):
            shape.append(x)
            left[x] -= 1
            gap -= x
        while gap:
            small = min(shape)
            pair = two(gap + small, small)
            if not pair:
                break
            shape.remove(small)
            left[small] += 1
            for x in pair:
                left[x] -= 1
            shape += pair
            gap = capacity - sum(shape)
        kinds, need = np.unique(shape, return_counts=True)
        # the same choices hold as long as every length involved is still there; half at a time keeps lengths for other shapes
        more = int((left[kinds] // need).min())
        more = more if len(shape) == 1 else more // 2
        left[kinds] -= need * more
        bins.append((sorted(shape, reverse=True), 1 + more))
    return bins


def place(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """The plan as runs, sorted by (length, first): pieces first.. of a length go to sequences base, base+1, ... at an offset."""
    used: dict[int, int] = {}
    runs, base = [], 0
    for shape, n in bins:
        at = 0
        for x in shape:
            runs.append((x, used.get(x, 0), base, at))
            used[x] = used.get(x, 0) + n
            at += x
        base += n
    runs.sort()
    return tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 4


def best_two_fit(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    table = written(pieces(docs, tokenizer, end_id, capacity).withColumn("mark", F.xxhash64("doc_id", "piece", "ids_crc32")), "pieces")
    return pack_pieces(table, capacity)


def pack_pieces(table: DataFrame, capacity: int, share: int = 100_000) -> DataFrame:
    """table: pieces with a hash in the column mark; read a few times, so it is best a written table.

    The pieces of a length are numbered in parts of about `share`, however many there are, so no task holds a whole length."""
    spark = table.sparkSession
    per_length = {r.length: r.n for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if not per_length:
        return table.drop("mark").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    parts = np.zeros(capacity + 1, np.int64)
    for n, c in per_length.items():
        parts[n] = 1 + c // share
    base = np.cumsum(parts) - parts
    deal = spark.createDataFrame([(int(n), int(parts[n]), int(base[n])) for n in per_length], "length long, parts long, base long")
    dealt = table.join(F.broadcast(deal), "length").withColumn("part", F.col("base") + F.pmod(F.col("mark"), F.col("parts"))).drop("parts", "base", "mark")
    here = np.zeros(int(parts.sum()), np.int64)
    for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect():  # at most capacity rows and one for each `share` pieces
        here[r.part] = r.n
    before = np.cumsum(here) - here
    before -= np.repeat(before[np.minimum(base, len(before) - 1)], parts)  # within its length
    count = np.zeros(capacity + 1, np.int64)
    count[list(per_length)] = list(per_length.values())
    runs = spark.sparkContext.broadcast((before, *place(plan_bins(count, capacity))))

    def look(batches):
        first, lengths, starts, base, at = runs.value
        step = np.int64(1) << 40  # (length, number) as one sorted key
        keys = lengths * step + starts
        for b in batches:
            size, part, rank = (np.asarray(b.column(k)) for k in ("length", "part", "rank"))
            number = first[part] + rank - 1
            i = np.searchsorted(keys, size * step + number, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(base[i] + number - starts[i]), pa.array(at[i])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "piece", "ids_crc32")))
    return ranked.mapInArrow(bare(look), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
