"""Operator 6, quality classification by nearest-neighbour voting in a latent-semantic space.

A text's terms are its bytes in threes, hashed to `terms` columns, and a few columns for words that repeat the word before them or a
recent pair of words. Term weights 1 + ln(count), times the idf of the labelled sample, form a unit vector that a truncated SVD of the
sample takes to `rank` latent dimensions. Every document is compared with all labelled vectors by exact blocked cosine products, and its
nearest `neighbours` vote. A vote weighs the similarity to the eighth power, which lets near neighbours decide, times how often the
neighbour's label occurs against its share of the sample. All neighbours as near as the last of the `neighbours` vote, so ties don't
depend on an order.

The labelled sample is bounded: at most `per_label` rows of each label, exactly those with the least hashes of doc_id. Null and empty texts
have no terms and get the sample's share of label 1, as does every text if no labels exist. Labels other than 0 and 1 are not used; of
labels that differ for one doc_id the least counts, and of texts that share a doc_id one is learned from. Rows with null or repeated doc_id
are scored like any other; an empty table gives no rows; a very long text counts whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bare, fold, free_names, least_rows, slices, word_hashes, words, worker_model

TERMS, EXTRA = 4096, 2
EXTRA_WEIGHT = 8.0  # a repetition term against a single byte term


def term_counts(block: np.ndarray, off: np.ndarray, terms: int = TERMS) -> np.ndarray:
    """rows x (terms + EXTRA) counts of whole texts."""
    n = len(off) - 1
    out = np.zeros((n, terms + EXTRA), np.float32)
    if len(block) >= 3:
        b = block.astype(np.uint32)
        code = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35)))
        code = (code * np.uint32(0x27D4EB2F)) >> np.uint32(32 - int(terms).bit_length() + 1)
        for k in range(n):
            if off[k + 1] - off[k] >= 3:
                out[k, :terms] = np.bincount(code[off[k] : off[k + 1] - 2], minlength=terms)
    starts, ends, first = words(block, off)
    if len(starts):
        h = word_hashes(LOWER[block], starts, ends)
        row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        total = np.maximum(np.diff(first), 1)
        out[:, terms] = 40 * np.bincount(row[same], minlength=n) / total
        pair = h.copy()
        pair[1:] += h[:-1] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(n):  # words in pairs that were there before
            p = pair[first[k] : first[k + 1]]
            if len(p) > 1:
                out[k, terms + 1] = 40 * (len(p) - len(np.unique(p))) / len(p)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class NeighbourModel:
    def __init__(self, counts: np.ndarray, labels: np.ndarray, prior: float, rank: int = 64, neighbours: int = 25):
        self.prior, self.neighbours = prior, min(neighbours, max(1, len(labels)))
        self.labels = labels.astype(np.float32)
        n = len(labels)
        self.idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        self.idf[TERMS:] *= EXTRA_WEIGHT
        x = weigh(counts, self.idf)
        rank = min(rank, *x.shape) if n else 0
        if rank:
            draw = np.random.default_rng(5).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
            q = np.linalg.qr(x @ draw)[0]
            for _ in range(4):
                q = np.linalg.qr(x @ (x.T @ q))[0]
            _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
            self.axes = np.ascontiguousarray(vt[:rank].T, np.float32)
            self.vectors = self._unit(x @ self.axes)
            # labels of the two kinds weigh as they occur, though the sample holds as many of each as the bound allows
            share = max(1e-6, min(1 - 1e-6, float(labels.mean())))
            self.weight = np.where(labels > 0, prior / share, (1 - prior) / (1 - share)).astype(np.float32)

    @staticmethod
    def _unit(y: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(y, axis=1, keepdims=True)
        return np.divide(y, size, out=np.zeros_like(y), where=size > 0)

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        y = self._unit(weigh(counts, self.idf) @ self.axes)
        k = self.neighbours
        for at in range(0, len(y), block):
            part = y[at : at + block]
            sim = part @ self.vectors.T
            last = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
            near = np.maximum(sim, 0)
            near *= sim >= last[:, None]
            for _ in range(3):
                near *= near
            total = near @ self.weight
            good = near @ (self.weight * self.labels)
            there = total > 0
            out[at : at + block][there] = good[there] / total[there]
        out[counts.sum(axis=1) == 0] = self.prior
        return np.clip(out, 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, learn_rows: Column, per_label: int = 2048) -> NeighbourModel:
    """Fit on at most per_label rows of each label among docs where learn_rows holds; their term counts come to the driver.

    Ids meet their labels and are chosen first; only the chosen rows' texts are read."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("q"))
    ids = docs.where(learn_rows).select("doc_id").distinct().join(marks, "doc_id").withColumn("draw", F.xxhash64(F.lit(11), "doc_id"))
    size = ids.groupBy("q").agg(F.count("*").alias("n")).collect()
    chosen = least_rows(ids.select("doc_id", "q", "draw"), "q", "draw", per_label)
    texts = docs.where(learn_rows).select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "q", "draw").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def count(batches):
        for b in batches:
            for start, block, off in slices(b.column(0)):
                c = term_counts(block, off)
                rows = [np.flatnonzero(x) for x in c]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(start, len(rows)), b.column(2).slice(start, len(rows)), pa.array([i.astype("<u2").tobytes() for i in rows]), pa.array([x[i].astype("<f4").tobytes() for x, i in zip(c, rows, strict=True)])], ["q", "draw", "at", "n"])

    kept = texts.select("text", "q", "draw").mapInArrow(bare(count), "q int, draw long, at binary, n binary").orderBy("draw", "at").collect()
    counts = np.zeros((len(kept), TERMS + EXTRA), np.float32)
    for k, r in enumerate(kept):
        counts[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<f4")
    total = {r.q: r.n for r in size}
    prior = total.get(1, 0) / sum(total.values()) if total else 1.0
    return NeighbourModel(counts, np.array([r.q for r in kept], np.float32), prior)


def scorer(spark, model: NeighbourModel):
    """A column function from text to score. The model is broadcast: at most 2 x per_label vectors and the terms' axes."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        worker_model(None)
        out = np.zeros(len(text))
        for start, block, off in slices(text):
            for a in range(0, len(off) - 1, 512):
                o = off[a : a + 513]
                out[start + a : start + a + len(o) - 1] = shared.value.score(term_counts(block[o[0] : o[-1]], o - o[0]))
        return pa.array(out)

    return score.asNondeterministic()


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; learns from the rows whose fold of 5 is not 0."""
    held = fold(F.col("doc_id"), 5) == 0
    udf = scorer(docs.sparkSession, learn(docs, labels, ~held))
    scored = docs.select("doc_id", held.alias("held_out"), udf(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    (score,) = free_names(docs, "__score")
    udf = scorer(docs.sparkSession, learn(docs, labels, fold(F.col("doc_id"), 5) != 0))
    return docs.withColumn(score, udf(F.col("text").cast("string"))).where(F.col(score) >= threshold).drop(score)
