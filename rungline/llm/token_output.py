"""Operator 1, token-id output: documents' ids in coded, checksummed blocks, in ascending doc_id order.

Null text counts as empty (only the end id is written). A null doc_id is kept and comes first; rows with equal doc_id follow each other by
their texts' hash, and may lie in several partitions. An empty table makes no block; a very long text is a block of its own. Blocks hold whole documents: about `block_tokens` ids, or one longer document. The folder is a Parquet table of blocks, so any
store that Spark writes to will do, half-written tasks are never seen, and a lost executor's task is simply run again."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bare, scratch_path, shuffle_width
from .idcoder import decode_block, encode_block
from .pieces import encoder, runs

BLOCKS = "part int, block int, part_start long, n_tokens long, n_docs int, data binary"


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_tokens: int = 4 << 20, width: int | None = None) -> None:
    """Encode docs(doc_id, text) and write blocks to the folder `path`. Partitions follow (doc_id, the text's hash) by range, so part and
    block give the order. width: how many partitions, by default one for each 20,000 rows and as many as a shuffle has at least."""

    def encode(batches):
        part, block, start = TaskContext.get().partitionId(), 0, 0
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        ids, docs_, sizes, held = [], [], [], 0

        def flush():
            nonlocal ids, docs_, sizes, held, block, start
            data = encode_block(docs_, np.array(sizes), np.frombuffer(b"".join(ids), "<u4"))
            row = pa.RecordBatch.from_pydict({"part": [part], "block": [block], "part_start": [start], "n_tokens": [held], "n_docs": [len(docs_)], "data": [data]}, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int32()), ("data", pa.binary())]))
            block, start = block + 1, start + held
            ids, docs_, sizes, held = [], [], [], 0
            return row

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in runs(texts, 1 << 24):  # the more at once, the fewer chunks are looked up and encoded twice
                for doc, x in zip(names[a:z], enc.ids_many(texts[a:z]), strict=True):
                    ids += [x, end]
                    docs_.append(doc)
                    sizes.append(len(x) // 4 + 1)
                    held += len(x) // 4 + 1
                    if held >= block_tokens:
                        yield flush()
        if docs_:
            yield flush()

    width = width or max(shuffle_width(docs.sparkSession), -(-docs.count() // 20_000))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = rows.repartitionByRange(width, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")
    rows.mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(path)


def read_token_blocks(spark, path: str) -> DataFrame:
    """Decode a folder of blocks: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit)."""
    return _documents(spark, path, "ids binary", lambda x: pa.array(x, pa.binary()))


def read_token_checksums(spark, path: str) -> DataFrame:
    """As read_token_blocks, with the ids' CRC-32 (ids_crc32) in place of the ids."""
    return _documents(spark, path, "ids_crc32 long", lambda x: pa.array([zlib.crc32(v) for v in x], pa.int64()))


def _documents(spark, path: str, last: str, made) -> DataFrame:
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row for each written partition: a number that the folder's file count bounds
    per_part = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    firsts = per_part.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))

    def decode(batches):
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs, sizes, ids = decode_block(data.as_py())
                sizes = sizes.astype(np.int64)
                stops = np.cumsum(sizes)
                for k in range(0, len(docs), 5000):
                    s, n = stops[k : k + 5000] - sizes[k : k + 5000], sizes[k : k + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[k : k + 5000], pa.int64()), pa.array(s + start), pa.array(n), made([ids[a : a + c].tobytes() for a, c in zip(s, n, strict=True)])], ["doc_id", "start", "n_tokens", last.split()[0]])

    placed = blocks.join(F.broadcast(firsts), "part").select((F.col("part_start") + F.col("first")).alias("start"), "data")
    return placed.mapInArrow(bare(decode), f"doc_id long, start long, n_tokens long, {last}")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, block_tokens: int = 4 << 20) -> DataFrame:
    """Write all documents and read the files back: doc_id, start, n_tokens, ids_crc32 for each document."""
    path = path or scratch_path(docs.sparkSession, "token-blocks")
    write_token_blocks(docs, path, tokenizer, end_id, block_tokens)
    return read_token_checksums(docs.sparkSession, path)
