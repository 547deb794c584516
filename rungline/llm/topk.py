"""Operator 5, exact top-k search by inner product with MaxScore over shards.

A vector's components are its terms. A shard keeps, term by term, every vector's component: dense vectors make each posting list a row of
the shard's term-major matrix, beside the term's largest and smallest component. For a query each term has a bound, the largest product
it can add in the shard. With a threshold from the best found so far, the terms of least bound that together can't reach it are
non-essential. Essential lists are traversed, those of the largest bounds first; vectors whose partial score plus what all other terms
can add falls short of the threshold are dropped on the way, and the non-essential terms are only probed for vectors that are still
competitive. A task takes its shards one after the other, so the threshold of a query rises from shard to shard; tasks' best are merged.
Scores are whole numbers held exactly (below 2**53, else in 64-bit integers).

Vectors stay where they are. Queries are sent to them in blocks of a bounded size, one round a block.

Vectors that are null or hold a null or non-finite component take no part; shorter vectors count as padded with zeros. Rows equal in
vec_id and vector count as often as they occur, and a query that occurs more than once is answered once. A null vec_id is no query; as a
candidate it sorts before all others. Ties go to the smaller vec_id. An empty table gives no rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bare, scratch_path, written

#: Essential lists are traversed so many at a time before vectors are dropped.
STEP = 8


class Shard:
    def __init__(self, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.times, v = ids[by], times[by], vectors[by]
        top = int(np.abs(v).max(initial=0))
        self.exact = np.float64 if top < (1 << 20) else np.int64
        self.terms = np.ascontiguousarray(v.T.astype(self.exact))
        self.most, self.least = self.terms.max(axis=1, initial=0), self.terms.min(axis=1, initial=0)
        self.products = 0  # multiplications done

    def _kth(self, scores: np.ndarray, who: np.ndarray, k: int) -> float:
        """The k-th best score among vectors, each counted as often as it occurs; -inf if there are fewer."""
        by = np.argsort(-scores, kind="stable")
        n = np.cumsum(self.times[who[by]])
        at = int(np.searchsorted(n, k))
        return float(scores[by[at]]) if at < len(by) else -math.inf

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -math.inf, seeds: int = 64) -> list[tuple[int, int]]:
        """The k best (score, vec_id) for a query, of those that reach `floor`. own: its vec_id, of which one copy of the same vector doesn't count."""
        q, n = query.astype(self.exact), len(self.ids)
        bound = np.maximum(q * self.most, q * self.least)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from each place on can add
        who = np.unique(np.linspace(0, n - 1, min(n, seeds)).astype(int))
        who = who[self.ids[who] != own]
        self.products += len(who) * len(q)
        floor = max(floor, self._kth(q @ self.terms[:, who], who, k)) if len(who) else floor
        # a vector that no essential list lifts can't reach the threshold
        essential = int(np.searchsorted(-rest, -floor, "right")) if floor > 0 else len(q)
        score, who, at = np.zeros(n, self.exact), None, 0
        while at < len(q) and (who is None or len(who)):
            to = min(at + STEP, essential if at < essential else len(q))
            some = order[at:to]
            lists = self.terms[some] if who is None else self.terms[np.ix_(some, who)]
            score = score + q[some] @ lists
            self.products += lists.size
            at = to
            if at >= essential or who is None or len(who) > 256:
                stay = np.flatnonzero(score + rest[at] >= floor)
                if at >= essential or 2 * len(stay) < len(score):
                    who, score = stay if who is None else who[stay], score[stay]
        who = np.arange(n) if who is None else who
        out: list[tuple[int, int]] = []
        for j in np.lexsort((self.ids[who], -score)):
            same = self.ids[who[j]] == own and (self.terms[:, who[j]] == q).all()
            times = min(int(self.times[who[j]]) - same, k - len(out))
            out += [(int(score[j]), int(self.ids[who[j]]))] * times
            if len(out) == k:
                break
        return out


_NULL_ID = -(1 << 63)


def _grid(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = np.asarray(column.flatten())
    return out


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, shard_rows: int = 8192, query_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row whose vec_id is divisible by `every`, against all rows.

    shard_rows: vectors of a shard, which a task holds one at a time; query_rows: queries of a round, which are broadcast."""
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(scale)))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    rows = written(rows, "vectors")
    size = rows.agg(F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.size("v")).alias("d")).first()
    width, blocks = size.d or 1, max(1, -(-size.q // query_rows))
    asked = rows.where(F.col("vec_id") % every == 0)
    path = scratch_path(spark, "best")
    for block in range(blocks):
        part = (asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block) if blocks > 1 else asked).select("vec_id", "v").toArrow()
        shared = spark.sparkContext.broadcast((np.asarray(part["vec_id"]), _grid(part["v"], width)))
        _best(rows, shared, k, width, shard_rows).write.mode("append").parquet(path)
        shared.unpersist()
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != _NULL_ID, F.col("vec_id")).alias("vec_id"), "score")


def _best(rows: DataFrame, shared, k: int, width: int, shard_rows: int) -> DataFrame:
    """query_id, vec_id, score: each task's k best for each query of a block."""

    def search(batches):
        ids, queries = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in ids]

        def look(held):
            shard = Shard(np.concatenate([np.asarray(b.column(0).fill_null(_NULL_ID)) for b in held]), np.concatenate([np.asarray(b.column(2)) for b in held]), np.concatenate([_grid(b.column(1), width) for b in held]))
            for r, own in enumerate(ids.tolist()):
                floor = best[r][-1][0] if len(best[r]) == k else -math.inf
                best[r] = sorted(best[r] + shard.search(queries[r], own, k, floor), key=lambda x: (-x[0], x[1]))[:k]

        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= shard_rows:
                look(held)
                held, n = [], 0
        if n:
            look(held)
        out = [(i, v, s) for i, found in zip(ids.tolist(), best, strict=True) for s, v in found]
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return rows.select("vec_id", "v", "times").mapInArrow(bare(search), "query_id long, vec_id long, score long")
