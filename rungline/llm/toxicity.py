"""Operator 12, toxicity by a convolutional text classifier with thresholds by language.

A word, lower-cased (A-Z) and freed of other signs at both ends, is hashed whole and by its first 4, 5, 6 and 7 bytes. The buckets seen in
enough taught documents have an embedding; others are zero. The first dimensions of an embedding hold how surely the bucket marks
label 1 (the lower bound of its log odds, for training from the folds that the document isn't in), the rest is trained. Filters over one,
two and three words are pooled to their maxima over the whole text, and a logistic layer weighs the maxima. The language is predicted from
the text alone, by word counts. A score is the logistic of the margin over the threshold, so 0.5 stands for the threshold in every language.

Every row of the learning folds with label 0 or 1 is learned from, whole. By a hash of doc_id three quarters are taught and a quarter is
spare. Spark joins texts with labels once and writes shards of about per_shard rows; then tasks count buckets and words; then, pass by pass,
each shard trains the layers by Adam from the same start and Spark averages the shards, embeddings by how often each was met; then the
spare rows' logits, counted in steps of 0.001, give a threshold for each language that has enough of both labels, and one for the rest.
Small tables get more passes (up to 8), large ones at least `passes`. Only counts by bucket and layers, which the bucket tables bound, come to
the driver.

Labels other than 0 and 1 are not used; of labels that differ for one doc_id the greatest counts, for each of its texts. Null and empty texts
have no windows and get the score of none. With no labels, or one label only, all score the share of label 1. Rows with null or repeated
doc_id are scored like any other; a very long text counts whole, 64 K words at a time; an empty table gives no rows; other columns, whatever
their names, are left out."""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bare, fold, slices, word_hashes, words, worker_model, written

WORD_BITS, PREFIX_BITS, PREFIXES = 17, 16, (4, 5, 6, 7)
KINDS = 1 + len(PREFIXES)
BASE = [0, *((1 << WORD_BITS) + (k << PREFIX_BITS) for k in range(KINDS))]  # where each kind's buckets begin if all are numbered through
WIDTHS, FILTERS, DIMS = (1, 2, 3), 8, 16
FOLDS, SPARE, LEAST = 4, 4, 4
LANG_BITS = 12
CHUNK = 10  # 2^CHUNK embeddings are averaged together
STEPS, FAR = 1000, 32_000  # logits are counted in steps of 1/STEPS, between -FAR and FAR steps
_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def word_codes(block: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words x KINDS hash buckets of the whole word and its prefixes (-1 for a prefix that is the word), and each row's first word."""
    starts, ends, first = words(block, off)
    if not len(starts):
        return np.zeros((0, KINDS), np.int32), first
    place = np.arange(len(block))
    last = np.maximum.accumulate(np.where(_SIGN[block], -1, place))[ends - 1] + 1
    begin = np.minimum.accumulate(np.where(_SIGN[block], len(block), place)[::-1])[::-1][starts]
    signs = last <= starts  # a word of signs only stays as it is
    starts, ends = np.where(signs, starts, begin), np.where(signs, ends, last)
    small = LOWER[block]
    out = np.full((len(starts), KINDS), -1, np.int32)
    out[:, 0] = word_hashes(small, starts, ends) >> np.uint64(64 - WORD_BITS)
    size = ends - starts
    for k, n in enumerate(PREFIXES):
        longer = np.flatnonzero(size > n)
        out[longer, k + 1] = word_hashes(small, starts[longer], starts[longer] + n) >> np.uint64(64 - PREFIX_BITS)
    return out, first


@dataclass
class Text:
    label: int
    lang: str | None
    codes: np.ndarray


def document_buckets(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct buckets, of all kinds: the row and the bucket, numbered through."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first)) * BASE[-1]
    key = np.concatenate([(row + codes[:, k] + BASE[k])[codes[:, k] >= 0] for k in range(KINDS)])
    key.sort()
    key = key[np.diff(key, prepend=-1) != 0]
    return key // BASE[-1], key % BASE[-1]


def _evidence(p: np.ndarray, n: np.ndarray, ps: int, ns: int) -> np.ndarray:
    """The lower bound of the log odds of label 1 for buckets in p of ps and n of ns documents, not below 0."""
    odds = np.log((p + 0.5) / (ps + 1)) - np.log((n + 0.5) / (ns + 1))
    return np.maximum(0, odds - 1.5 * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))).astype(np.float32)


def _joined(texts: list[Text]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([t.codes for t in texts]), np.concatenate([[0], np.cumsum([len(t.codes) for t in texts])])


class Convolution:
    """Embeddings by bucket and the layers over them. `tables[k]` gives the row of `vectors` of each bucket of kind k, 0 if unknown."""

    def __init__(self, texts: list[Text], seed: int = 3, least: int = LEAST, folds: int = FOLDS, epochs: int = 8, batch: int = 64):
        """Of texts at hand, as one shard."""
        label, part = np.array([t.label for t in texts]), np.arange(len(texts)) % folds
        doc, bucket = document_buckets(*_joined(texts))
        count = np.zeros((2, folds, BASE[-1]), np.int64)
        np.add.at(count, (label[doc], part[doc], bucket), 1)
        self.begin(count, np.array([[((label == y) & (part == f)).sum() for f in range(folds)] for y in (0, 1)]), seed, least)
        rng, trainer = np.random.default_rng(seed), Trainer(self)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for s in range(0, len(order), batch):
                some = order[s : s + batch]
                trainer.step(*_joined([texts[d] for d in some]), label[some], part[some])

    @classmethod
    def of_counts(cls, count: np.ndarray, total: np.ndarray, seed: int = 3, least: int = LEAST) -> Convolution:
        """count: documents by label, fold and bucket; total: documents by label and fold."""
        net = cls.__new__(cls)
        net.begin(count, total, seed, least)
        return net

    def begin(self, count: np.ndarray, total: np.ndarray, seed: int, least: int) -> None:
        rng = np.random.default_rng(seed)
        kept = np.flatnonzero(count.sum(axis=(0, 1)) >= least)
        table = np.zeros(BASE[-1], np.int32)
        table[kept] = np.arange(1, 1 + len(kept))
        self.tables = [table[a:b] for a, b in zip(BASE[:-1], BASE[1:], strict=True)]
        own = count[:, :, kept]
        all_ = own.sum(axis=1)
        self.vectors = np.zeros((1 + len(kept), DIMS), np.float32)
        kind = np.searchsorted(BASE, kept, "right") - 1
        self.vectors[np.arange(1, 1 + len(kept)), kind] = _evidence(all_[1], all_[0], total[1].sum(), total[0].sum())
        self.apart = np.zeros((count.shape[1], 1 + len(kept)), np.float32)  # the evidence of all folds but one
        for f in range(len(self.apart)):
            self.apart[f, 1:] = _evidence(all_[1] - own[1, f], all_[0] - own[0, f], total[1].sum() - total[1, f], total[0].sum() - total[0, f])
        self.weight = 0.5 * total.sum() / np.maximum(1, total.sum(axis=1))  # of a document, by label
        self.vectors[1:, KINDS:] = 0.1 * rng.standard_normal((len(kept), DIMS - KINDS))
        self.filters = [0.1 * rng.standard_normal((w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.filters[0][0, :KINDS, :KINDS] += np.eye(KINDS, dtype=np.float32)  # each kind of evidence has a filter to begin with
        self.filters[0][0, :KINDS, KINDS] += 0.5
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.constant = np.zeros(1, np.float32)

    def layers(self) -> list[np.ndarray]:
        """All that is trained but the embeddings."""
        return [*self.filters, self.bias, self.out, self.constant]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """words x KINDS rows of `vectors`."""
        return np.stack([np.where(codes[:, k] >= 0, t[codes[:, k]], 0) for k, t in enumerate(self.tables)], axis=1)

    def _conv(self, x: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The filters' values of the windows from each word on. left: the words of the row from this one on; windows end with their row."""
        weight = np.concatenate([w[j] for w in self.filters for j in range(len(w))], axis=1)
        p, out, at = x @ weight, [], 0
        for w in WIDTHS:
            total = p[:, at : at + FILTERS]
            for j in range(1, w):
                at += FILTERS
                total = total.copy() if j == 1 else total
                total[:-j] += p[j:, at : at + FILTERS] * (left[:-j] > j)[:, None]
            at += FILTERS
            out.append(total)
        return np.concatenate(out, axis=1)

    def pieces(self, codes: np.ndarray, first: np.ndarray, x_of, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """`size` words are convolved at a time, whatever rows they are of: the first word, the values, which rows, and where each begins."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for a in range(0, len(codes), size):
            b = min(a + size, len(codes))
            more = min(b + max(WIDTHS) - 1, len(codes))
            value = self._conv(x_of(self.rows(codes[a:more]), row[a:more]), first[row[a:more] + 1] - np.arange(a, more))[: b - a]
            cut = np.flatnonzero(np.diff(row[a:b], prepend=-1))
            yield a, value, row[a:b][cut], cut

    def logits(self, codes: np.ndarray, first: np.ndarray, size: int = 1 << 16) -> np.ndarray:
        """The logit of each row."""
        best = np.full((len(first) - 1, len(self.bias)), -np.inf, np.float32)
        for _, value, at, cut in self.pieces(codes, first, lambda idx, row: self.vectors[idx].sum(axis=1), size):
            best[at] = np.maximum(best[at], np.maximum.reduceat(value, cut, axis=0))
        return np.maximum(best + self.bias, 0) @ self.out + self.constant


class Trainer:
    """Adam over one shard. Embeddings that no maximum meets stay as they are, so a step costs what its documents cost."""

    def __init__(self, net: Convolution, rate: float = 0.01):
        self.net, self.rate, self.steps, self.documents = net, rate, 0, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.layers()]
        self.of_rows = tuple(np.zeros((len(net.vectors), DIMS - KINDS), np.float32) for _ in range(2))
        self.met = np.zeros(len(net.vectors), np.float32)

    def _x(self, idx: np.ndarray, part: np.ndarray) -> np.ndarray:
        x = self.net.vectors[idx].sum(axis=1)
        for k in range(KINDS):
            x[:, k] = self.net.apart[part, idx[:, k]]
        return x

    def step(self, codes: np.ndarray, first: np.ndarray, label: np.ndarray, part: np.ndarray, size: int = 1 << 16) -> None:
        net, n, width = self.net, len(label), len(self.net.bias)
        best, at = np.full((n, width), -np.inf, np.float32), np.zeros((n, width), np.int64)
        for a, value, rows, cut in net.pieces(codes, first, lambda idx, row: self._x(idx, part[row]), size):
            for d, s, e in zip(rows, cut, [*cut[1:], len(value)], strict=True):
                top = s + value[s:e].argmax(axis=0)
                high = value[top, np.arange(width)]
                better = high > best[d]
                best[d], at[d] = np.where(better, high, best[d]), np.where(better, a + top, at[d])
        top = np.where((np.diff(first) > 0)[:, None], best + net.bias, 0)
        pooled = np.maximum(top, 0)
        z = pooled @ net.out + net.constant
        d = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - label) * net.weight[label] / n).astype(np.float32)
        flow = d[:, None] * net.out * (top > 0)
        grads = [*(np.zeros_like(f) for f in net.filters), flow.sum(axis=0), pooled.T @ d + 1e-4 * net.out, d.sum(keepdims=True)]
        met, back = [], []
        for k, w in enumerate(WIDTHS if len(codes) else ()):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(w):
                on = flow[:, own] * (first[1:, None] - at[:, own] > j)
                some, f = np.nonzero(on)
                idx = net.rows(codes[at[:, own][some, f] + j])
                value = on[some, f][:, None]
                np.add.at(grads[k][j].T, f, value * self._x(idx, part[some]))
                met.append(idx)
                back.append(value * net.filters[k][j].T[f][:, KINDS:])  # evidence stays what it is
        self.steps += 1
        self.documents += n
        for p, g, (m, v) in zip(net.layers(), grads, self.moments, strict=True):
            p -= self._adam(g, m, v, self.steps)
        if met:
            self._embeddings(np.concatenate(met), np.concatenate(back))

    def _adam(self, g, m, v, steps):
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        return self.rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)

    def _embeddings(self, idx: np.ndarray, back: np.ndarray) -> None:
        flat = idx.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 1) :]  # row 0, of unknown buckets, stays zero
        if not len(order):
            return
        start = np.flatnonzero(np.diff(flat[order], prepend=0))
        some = flat[order[start]]
        g = np.add.reduceat(back[order // KINDS], start, axis=0)
        self.met[some] += 1
        m, v = (x[some] for x in self.of_rows)
        self.net.vectors[some, KINDS:] -= self._adam(g, m, v, self.met[some][:, None])
        self.of_rows[0][some], self.of_rows[1][some] = m, v

    def changed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Chunk by chunk the embeddings that were met: their numbers, how often, and their trained values. Chunk -1: the layers."""
        yield -1, np.zeros(1, np.int32), np.array([self.documents], np.float32), np.concatenate([p.ravel() for p in self.net.layers()])
        some = np.flatnonzero(self.met).astype(np.int32)
        for chunk, at in groupby(range(len(some)), key=lambda i: some[i] >> CHUNK):
            own = some[list(at)]
            yield int(chunk), own, self.met[own], self.net.vectors[own, KINDS:]


def trained(taught: DataFrame, net: Convolution, batch: int = 64) -> Convolution:
    """One pass over taught(text, q, fold, part): each part trains from the same start; then all are averaged."""
    shared = taught.sparkSession.sparkContext.broadcast(net)

    def train(batches):
        trainer, last = None, None
        for part, codes, first, q, f in _documents(batches):
            if part != last:
                yield from flushed(trainer, last)
                trainer, last = Trainer(deepcopy(shared.value)), part
            n = len(q)
            for some in np.array_split(np.arange(n), -(-n // batch)):
                i, j = first[some[0]], first[some[-1] + 1]
                trainer.step(codes[i:j], first[some[0] : some[-1] + 2] - i, q[some], f[some])
        yield from flushed(trainer, last)

    def flushed(trainer, part):
        for chunk, *arrays in trainer.changed() if trainer else ():
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([task], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names)

    def average(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["task"]))
        each = [(np.frombuffer(r["row"], np.int32), np.frombuffer(r["met"], np.float32), np.frombuffer(r["value"], np.float32)) for r in rows]
        row = np.unique(np.concatenate([x for x, _, _ in each]))
        weight, total = np.zeros(len(row)), np.zeros((len(row), len(each[0][2]) // len(each[0][0])))
        for x, met, value in each:
            at = np.searchsorted(row, x)
            weight[at] += met
            total[at] += met[:, None] * value.reshape(len(x), -1).astype(float)
        mean = (total / weight[:, None]).astype(np.float32)
        return pa.table({"chunk": pa.array([rows[0]["chunk"]], pa.int32()), "row": [row.tobytes()], "value": [mean.tobytes()]})

    names = ["chunk", "part", "task", "row", "met", "value"]
    changes = taught.select("text", "q", "fold", "part").mapInArrow(bare(train), "chunk int, part int, task int, row binary, met binary, value binary")
    out = deepcopy(net)
    for r in changes.groupBy("chunk").applyInArrow(average, "chunk int, row binary, value binary").collect():
        value = np.frombuffer(r.value, np.float32)
        if r.chunk < 0:
            at = 0
            for p in out.layers():
                p[...] = value[at : at + p.size].reshape(p.shape)
                at += p.size
        else:
            out.vectors[np.frombuffer(r.row, np.int32), KINDS:] = value.reshape(-1, DIMS - KINDS)
    shared.unpersist()
    return out


def _documents(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From batches of text, q, fold, part: the part, the words' buckets, each row's first word, q and fold, of about a megabyte of texts."""
    for b in batches:
        part = b.column(3).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            q, f = (b.column(k).slice(a, z - a).to_numpy() for k in (1, 2))
            for at, block, off in slices(b.column(0).slice(a, z - a)):
                n = len(off) - 1
                yield int(part[a]), *word_codes(block, off), q[at : at + n], f[at : at + n]


class LanguageGuess:
    """The language of a text by its words' counts: the named languages, and if count has one more column, all others together."""

    def __init__(self, names: list[str], count: np.ndarray):
        self.names, self.shift = names, WORD_BITS - LANG_BITS
        count = count[:, : len(names) + bool(count[:, len(names) :].any())] + 0.1
        self.log = np.log(count / count.sum(axis=0)).astype(np.float32)

    def of(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each row's language by number, -1 for none of the named."""
        out = np.full(len(first) - 1, -1)
        full = np.flatnonzero(np.diff(first))
        if len(full) and self.names:
            total = np.zeros((len(full), self.log.shape[1]), np.float32)
            word = codes[:, 0] >> self.shift
            for k in range(total.shape[1]):
                total[:, k] = np.add.reduceat(self.log[word, k], first[full])
            best = total.argmax(axis=1)
            out[full] = np.where(best < len(self.names), best, -1)
        return out


def threshold(z: np.ndarray, y: np.ndarray, share: float) -> float:
    """The logit that gives the best F1 if label 1 has this share of all documents; the middle of the gap there."""
    value, at = np.unique(z, return_inverse=True)
    return counted_threshold(value, *(np.bincount(at[y == k], minlength=len(value)) for k in (1, 0)), share)


def counted_threshold(value: np.ndarray, ones: np.ndarray, zeros: np.ndarray, share: float) -> float:
    """As threshold, from how many documents of each label have each of the ascending logits."""
    hit = np.cumsum(ones[::-1]) / max(1, ones.sum()) * share
    false = np.cumsum(zeros[::-1]) / max(1, zeros.sum()) * (1 - share)
    k = len(value) - 1 - int(np.argmax(2 * hit / (share + hit + false)))
    return float((value[k] + value[k - 1]) / 2) if k else float(value[0] - 1)


class ToxicityModel:
    def __init__(self, share: float, net: Convolution | None = None, guess: LanguageGuess | None = None):
        self.share, self.net, self.guess = share, net, guess
        self.thresholds = np.zeros(1 + len(guess.names) if guess else 1)  # the last is for the rest

    def logits(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.net.logits(codes, first), self.guess.of(codes, first)

    def scores(self, block: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(off) - 1, self.share)
        z, lang = self.logits(*word_codes(block, off))
        z = z - self.thresholds[lang]
        return 1 / (1 + np.exp(-np.clip(np.round(z.astype(np.float64), 4), -50, 50)))


def marked_texts(docs: DataFrame, labels: DataFrame, learn_rows: Column, per_shard: int) -> DataFrame:
    """Every row of docs where learn_rows holds that has label 0 or 1, written in shards: text, lang, q, spare, fold, part."""
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("q"))
    shards = max(1, -(-marks.count() // per_shard))
    draw = F.xxhash64(F.lit(12), "doc_id")
    text, lang = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")
    # both sides grow with the tables, so they meet by a merge at every size
    rows = docs.where(learn_rows).select("doc_id", text, lang).join(marks.hint("merge"), "doc_id").withColumn("draw", draw)
    rows = rows.coalesce(shards).sortWithinPartitions("draw", "text")  # an order that ids have no part in
    spare, part = F.pmod("draw", F.lit(SPARE)) == SPARE - 1, F.pmod(F.shiftright("draw", 8), F.lit(FOLDS)).cast("int")
    return written(rows.select("text", "lang", "q", spare.alias("spare"), part.alias("fold"), F.spark_partition_id().alias("part")), "toxicity")


def bucket_counts(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Documents that aren't spare by label, fold and bucket (of buckets in LEAST or more), and words by hash and language, the last column for others."""
    number, others = {x: k for k, x in enumerate(names)}, len(names)
    cells = [f"n{k}" for k in range(2 * FOLDS)]

    def count(batches):
        docs, heard = np.zeros((2 * FOLDS, BASE[-1]), np.int64), np.zeros((others + 1, 1 << LANG_BITS), np.int64)
        for b in batches:
            q, part, spare = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            lang = np.array([-1 if x is None else number.get(x, others) for x in b.column(4).to_pylist()])
            for at, block, off in slices(b.column(0)):
                own = slice(at, at + len(off) - 1)
                codes, first = word_codes(block, off)
                doc, bucket = document_buckets(codes, first)
                taught = ~spare[own][doc]
                cell = (q[own] * FOLDS + part[own])[doc[taught]].astype(np.int64)
                np.add.at(docs.reshape(-1), cell * BASE[-1] + bucket[taught], 1)
                of = np.repeat(lang[own], np.diff(first)).astype(np.int64)
                np.add.at(heard.reshape(-1), (of << LANG_BITS)[of >= 0] + (codes[:, 0] >> (WORD_BITS - LANG_BITS))[of >= 0], 1)
        key = np.flatnonzero(docs.any(axis=0))
        for a in range(0, len(key), 1 << 16):
            some = key[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in docs)], ["key", *cells])
        key = np.flatnonzero(heard)
        none = pa.array(np.zeros(len(key), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(key + BASE[-1]), pa.array(heard.reshape(-1)[key]), *[none] * (len(cells) - 1)], ["key", *cells])

    counted = rows.select("text", "q", "fold", "spare", "lang").mapInArrow(bare(count), ", ".join(f"{c} long" for c in ["key", *cells]))
    counted = counted.groupBy("key").agg(*(F.sum(c).alias(c) for c in cells))
    got = counted.where((F.col("key") >= BASE[-1]) | (sum(F.col(c) for c in cells) >= LEAST)).toArrow()
    key, n = got["key"].to_numpy(), np.stack([got[c].to_numpy() for c in cells])
    docs, heard = np.zeros((2 * FOLDS, BASE[-1]), np.int64), np.zeros((others + 1) << LANG_BITS, np.int64)
    low = key < BASE[-1]
    docs[:, key[low]] = n[:, low]
    heard[key[~low] - BASE[-1]] = n[0, ~low]
    return docs.reshape(2, FOLDS, -1), heard.reshape(others + 1, -1).T


def set_thresholds(model: ToxicityModel, spare: DataFrame, enough: int) -> None:
    """Of all spare rows: how many of each label have each logit, by language."""
    shared = spare.sparkSession.sparkContext.broadcast(model)

    def logits(batches):
        for _, codes, first, q, _ in _documents(batches):
            z, lang = shared.value.logits(codes, first)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(np.clip(np.rint(z * STEPS), -FAR, FAR).astype(np.int32)), pa.array(q, pa.int32())], ["lang", "z", "q"])

    got = spare.select("text", "q", "fold", "part").mapInArrow(bare(logits), "lang int, z int, q int")
    got = got.groupBy("lang", "z").agg(F.count_if(F.col("q") == 1).alias("ones"), F.count_if(F.col("q") == 0).alias("zeros")).toArrow()
    lang, z, ones, zeros = (got[c].to_numpy() for c in ("lang", "z", "ones", "zeros"))

    def best(own):
        value, at = np.unique(z[own], return_inverse=True)
        return counted_threshold(value / STEPS, np.bincount(at, ones[own]), np.bincount(at, zeros[own]), model.share)

    model.thresholds[:] = best(np.full(len(z), True))
    for k in range(len(model.guess.names)):
        if min(ones[lang == k].sum(), zeros[lang == k].sum()) >= enough:
            model.thresholds[k] = best(lang == k)
    shared.unpersist()


def learn(docs: DataFrame, labels: DataFrame, learn_rows: Column, per_shard: int = 8192, passes: int = 1, enough: int = 20) -> ToxicityModel:
    """Fit on every row of docs with a label where learn_rows holds."""
    rows = marked_texts(docs, labels, learn_rows, per_shard)
    total = np.zeros((2, 2, FOLDS), np.int64)
    for r in rows.groupBy("spare", "q", "fold").count().collect():
        total[int(r.spare), r.q, r.fold] = r["count"]
    n = int(total.sum())
    share = float(total[:, 1].sum() / max(1, n))
    if not 0 < share < 1:
        return ToxicityModel(share)
    if not total.sum(axis=2).all():  # too few to keep some back
        rows, taught, spare, total = rows.withColumn("spare", F.lit(False)), F.lit(True), F.lit(True), total.sum(axis=0, keepdims=True)
    else:
        taught, spare = ~F.col("spare"), F.col("spare")
    named = rows.where(spare & F.col("lang").isNotNull()).groupBy("lang").agg(F.count_if(F.col("q") == 1).alias("ones"), F.count_if(F.col("q") == 0).alias("zeros"))
    names = sorted(r.lang for r in named.where((F.col("ones") >= enough) & (F.col("zeros") >= enough)).collect())
    count, heard = bucket_counts(rows, names)
    net = Convolution.of_counts(count, total[0])
    for _ in range(max(passes, min(8, -(-4 * per_shard // n)))):
        net = trained(rows.where(taught), net)
    net.apart = None  # for training only
    model = ToxicityModel(share, net, LanguageGuess(names, heard))
    set_thresholds(model, rows.where(spare), enough)
    return model


def scorer(spark, model: ToxicityModel):
    """A column function from text to score. The model is broadcast: 2^17 buckets a table at most, whatever the data's size."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        worker_model(None)
        out = np.zeros(len(text))
        for at, block, off in slices(text):
            out[at : at + len(off) - 1] = shared.value.scores(block, off)
        return pa.array(out)

    return score.asNondeterministic()


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; learns from the rows whose fold of 5 is not 0."""
    held = fold(F.col("doc_id"), 5) == 0
    udf = scorer(docs.sparkSession, learn(docs, labels, ~held))
    scored = docs.select("doc_id", held.alias("held_out"), udf(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= cutoff, 1).otherwise(0).alias("predicted"))
