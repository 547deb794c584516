"""Operator 3, language-model scoring by context-tree weighting over bytes.

A text is coded as its words, A-Z lower-cased, each followed by a space, and an end sign (so white space between words has one form).
Each byte is eight binary decisions; each decision has a node in the trees of the contexts of 0 to `DEPTH` bytes before it. A node's
estimate is Krichevsky-Trofimov's, from its counts of zeros and ones in the training texts. Weights follow from the counts: a node's
weighted probability is half its own block probability and half the product of its children's, so the share of "stop here" against
"look one byte further" is known for every node, and a prediction mixes the estimates of all depths. A context that the model doesn't
hold leaves the decision to the depths above it.

Training counts are (context, byte) counts of all training texts, gathered by a shuffle that grows with the input. Each distinct window of
the texts to score meets the whole subtree of its last three context bytes and gets its mix of the depths below; the nodes of depths 0 to
2 (fewer than 2**24, whatever the input) are broadcast and finish it. So a score comes from all nodes at any size of the input. What else
is broadcast is a cache: the logs of the `max_windows` most counted windows and the counts of the `max_words` most counted words, each by
one count threshold; all other windows and words go through shuffled joins and count the same. Words are told apart by 64-bit hashes. Null and empty texts are just the end sign; rows with null or repeated doc_id are scored like any other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bare, fold, shared_dir, slices, word_hashes, words, worker_model, written

DEPTH = 5
END = 0x0A
RUN = 1 << 20  # bytes of text coded at a time, which bounds the arrays a worker needs for it
_U = np.uint64


# ------------------------------------------------------------------ coding of texts


def coded(block: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of DEPTH context bytes (oldest highest) and a byte, and where each row's windows end."""
    n = len(off) - 1
    times = np.zeros(len(block), np.int8)
    if len(starts):
        edge = np.zeros(len(block) + 1, np.int8)
        edge[starts] += 1
        np.add.at(edge, ends, -1)
        times = np.cumsum(edge[:-1], dtype=np.int8)
        times[ends - 1] += 1
    place = np.cumsum(times, dtype=np.int64)
    flat = np.repeat(block, times)
    if len(starts):
        flat[place[ends - 1] - 1] = 0x20
    stop = np.where(off[1:] > 0, place[np.maximum(off[1:], 1) - 1] if len(place) else 0, 0)
    # each row: DEPTH end signs before it, then its bytes, then its end sign
    size = np.diff(np.concatenate([[0], stop])) + DEPTH + 1
    row_end = np.cumsum(size)
    body = np.full(int(row_end[-1]) if n else 0, END, np.uint8)
    inside = np.ones(len(body), bool)
    lead = (row_end - size)[:, None] + np.arange(DEPTH)
    inside[lead.ravel()] = False
    windows = inside.copy()
    inside[row_end - 1] = False
    body[inside] = flat
    code = np.zeros(len(body), _U)
    for j in range(DEPTH + 1):
        code[j:] |= body[: len(body) - j].astype(_U) << _U(8 * j)
    return code[windows], row_end - DEPTH * np.arange(1, n + 1)


class Counter:
    """Counts of 64-bit keys, merged from batch to batch; `full` once many are held."""

    def __init__(self, most: int = 1_000_000):
        self.keys, self.n, self.most = np.zeros(0, _U), np.zeros(0, np.int64), most
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        u, n = np.unique(keys, return_counts=True)
        self.new.append((u, n))
        self.held += len(u)
        if self.held > 500_000:
            self.merge()

    def merge(self) -> None:
        k = np.concatenate([self.keys, *(u for u, _ in self.new)])
        n = np.concatenate([self.n, *(c for _, c in self.new)])
        by = np.argsort(k, kind="stable")
        k, n = k[by], n[by]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        self.keys, self.n = k[first], np.add.reduceat(n, first) if len(k) else n
        self.new, self.held = [], 0

    def rows(self, kind: int):
        self.merge()
        for a in range(0, len(self.keys), 50_000):
            k, n = self.keys[a : a + 50_000], self.n[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n)], ["kind", "key", "n"])
        self.keys, self.n = np.zeros(0, _U), np.zeros(0, np.int64)


def gather(train: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 words by hash, 1 windows, 2 documents."""

    def count(batches):
        word, window, docs = Counter(), Counter(), 0
        for b in batches:
            for _, block, off in slices(b.column(0), RUN):
                low = LOWER[block]
                starts, ends, _ = words(low, off)
                word.add(word_hashes(low, starts, ends))
                window.add(coded(low, off, starts, ends)[0])
                docs += len(off) - 1
            for kind, c in ((0, word), (1, window)):
                if len(c.keys) > c.most:
                    yield from c.rows(kind)
        yield from word.rows(0)
        yield from window.rows(1)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], ["kind", "key", "n"])

    return train.select("text").mapInArrow(bare(count), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ trees

_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097) - 0.5))])  # ln Gamma(n + 1/2) - ln Gamma(1/2)
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097)))])


def _log_rise(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """ln Gamma(n + shift) - ln Gamma(shift), by table and, beyond it, Stirling's series from the table's end."""
    s = lambda x: (x - 0.5) * np.log(x) - x + 1 / (12 * x)
    big = n > 4096
    out = table[np.minimum(n, 4096)]
    if big.any():
        out = out + np.where(big, s(np.maximum(n, 4096) + shift) - s(4096 + shift), 0.0)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _log_rise(n0, _HALF, 0.5) + _log_rise(n1, _HALF, 0.5) - _log_rise(n0 + n1, _WHOLE, 1.0)


def nodes_of(ctx: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (context << 8 | place in the byte's binary tree), their counts of zeros and ones, and the place of each window's eight keys."""
    level = np.arange(8)
    place = (1 << level) | (byte[:, None].astype(np.int64) >> (8 - level))
    bit = (byte[:, None].astype(np.int64) >> (7 - level)) & 1
    key = ((ctx[:, None].astype(np.int64) << 8) | place).ravel()
    u, at = np.unique(key, return_inverse=True)
    ones = np.bincount(at, weights=(bit * n[:, None]).ravel(), minlength=len(u)).astype(np.int64)
    both = np.bincount(at, weights=np.broadcast_to(n[:, None], bit.shape).ravel(), minlength=len(u)).astype(np.int64)
    return u, both - ones, ones, at.reshape(bit.shape)


def weigh(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None):
    """Weighted log probability and the share of "stop here" for each node. below: keys and weighted logs of the depth beneath."""
    own = log_kt(n0, n1)
    if below is None:
        return own, np.ones(len(key))
    child, logs = below
    parent = (child >> 16 << 8) | (child & 255)
    under = np.bincount(np.searchsorted(key, parent), weights=logs, minlength=len(key))
    both = np.logaddexp(own, under) + np.log(0.5)
    return both, np.exp(np.log(0.5) + own - both)


def turned(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A window's context with its latest byte highest, and its last byte."""
    ctx = np.zeros(len(code), _U)
    for j in range(1, DEPTH + 1):
        ctx = (ctx << _U(8)) | ((code >> _U(8 * j)) & _U(255))
    return ctx, (code & _U(255))


NODES = "depth int, key long, n long, n1 long, stop double, log double"


def trees(windows: DataFrame, width: int) -> DataFrame:
    """Nodes of depths 2 to DEPTH, for fit(). Rows that share the last two context bytes meet in one partition, so subtrees are whole."""

    def build(batches):
        parts = [(np.asarray(b.column(0)).view(_U), np.asarray(b.column(1))) for b in batches]
        if not parts:
            return
        code, n = np.concatenate([c for c, _ in parts]), np.concatenate([x for _, x in parts])
        ctx, byte = turned(code)
        below = None
        for depth in range(DEPTH, 1, -1):
            key, n0, n1, _ = nodes_of(ctx >> _U(8 * (DEPTH - depth)), byte, n)
            log, stop = weigh(key, n0, n1, below)
            below = key, log
            for a in range(0, len(key), 50_000):
                s = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[s]), depth, np.int32)), pa.array(key[s]), pa.array((n0 + n1)[s]), pa.array(n1[s]), pa.array(stop[s]), pa.array(log[s])], ["depth", "key", "n", "n1", "stop", "log"])

    last_two = F.shiftright(F.col("key"), 8).bitwiseAND(F.lit(0xFFFF))
    return windows.select("key", "n").repartition(width, last_two).mapInArrow(bare(build), NODES)


UPPER = 2


def mixed(deeper: np.ndarray, bit: np.ndarray, n: np.ndarray, n1: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Probabilities of bits by the depths so far and one depth above them. NaN: no depth so far has the node; n = 0: this one hasn't either."""
    kt = (np.where(bit, n1, n - n1) + 0.5) / (n + 1.0)
    return np.where(n > 0, np.where(np.isnan(deeper), kt, stop * kt + (1 - stop) * deeper), deeper)


def subtrees(windows: DataFrame, width: int, block: int = 50_000) -> DataFrame:
    """From (key, n in training texts, seen in all texts), kind 1: each distinct window, how often it was seen (n), and its bits'
    probabilities by depths DEPTH to UPPER + 1; kind 0: parts of the sums that the nodes of depth UPPER need.

    Rows that share the last UPPER + 1 context bytes meet in one partition; about `block` of them are expanded to nodes at a time."""

    def build(batches):
        parts = [[np.asarray(b.column(k)) for k in range(3)] for b in batches]
        if not parts:
            return
        code, n, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
        ctx, byte = turned(code.view(_U))
        whole, first, back = np.unique(((ctx << _U(8)) | byte).astype(np.int64), return_index=True, return_inverse=True)
        code = code[first]
        n, seen = (np.bincount(back, weights=x, minlength=len(whole)).astype(np.int64) for x in (n, seen))
        top = whole >> 8 * (DEPTH - UPPER)
        cuts = np.append(np.flatnonzero(top[1:] != top[:-1]) + 1, len(whole))
        a = 0
        while a < len(whole):
            z = int(cuts[min(np.searchsorted(cuts, a + block), len(cuts) - 1)])
            ctx, byte = whole[a:z] >> 8, whole[a:z] & 255
            bit = (byte[:, None] >> (7 - np.arange(8))) & 1
            q, below = np.full(bit.shape, np.nan), None
            for depth in range(DEPTH, UPPER, -1):
                # windows of other texts add nodes with no counts, whose weighted log is 0
                key, n0, n1, at = nodes_of(ctx >> 8 * (DEPTH - depth), byte, n[a:z])
                log, stop = weigh(key, n0, n1, below)
                below = key, log
                q = mixed(q, bit, (n0 + n1)[at], n1[at], stop[at])
            for y in range(a, z, 10_000):
                x = min(z, y + 10_000)
                part = [r.tobytes() for r in q[y - a : x - a].astype("<f4")]
                zero = np.zeros(x - y)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(x - y, np.int32)), pa.array(code[y:x]), pa.array(seen[y:x]), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(part, pa.binary())], SUBTREES_NAMES)
            there = n0 + n1 > 0
            up, at = np.unique(((key >> 16 << 8) | (key & 255))[there], return_inverse=True)
            add = lambda x: np.bincount(at, weights=x[there], minlength=len(up))  # noqa: E731, B023
            for y in range(0, len(up), 50_000):
                s = slice(y, y + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(up[s]), np.int32)), pa.array(up[s]), pa.array(add(n0 + n1)[s].astype(np.int64)), pa.array(add(n1)[s].astype(np.int64)), pa.array(add(log)[s]), pa.nulls(len(up[s]), pa.binary())], SUBTREES_NAMES)
            a = z

    last_three = F.shiftright(F.col("key"), 8).bitwiseAND(F.lit((1 << 8 * (UPPER + 1)) - 1))
    return windows.select("key", "n", "seen").repartition(width, last_three).mapInArrow(bare(build), SUBTREES)


SUBTREES = "kind int, key long, n long, n1 long, log double, part binary"
SUBTREES_NAMES = ["kind", "key", "n", "n1", "log", "part"]


class Upper:
    """All nodes of depths UPPER to 0, from the sums of depth UPPER: sorted keys, counts, counts of ones, weighted logs of the children."""

    def __init__(self, key: np.ndarray, n: np.ndarray, n1: np.ndarray, under: np.ndarray):
        self.nodes = []
        for d in range(UPPER, -1, -1):
            own = log_kt(n - n1, n1)
            both = np.logaddexp(own, under) + np.log(0.5)
            self.nodes.append((d, key, n, n1, np.exp(np.log(0.5) + own - both)))
            if d:
                up, at = np.unique((key >> 16 << 8) | (key & 255), return_inverse=True)
                add = lambda x: np.bincount(at, weights=x, minlength=len(up))  # noqa: E731, B023
                key, n, n1, under = up, add(n).astype(np.int64), add(n1).astype(np.int64), add(both)

    def logs(self, code: np.ndarray, q: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte. q: its bits' probabilities by the depths below."""
        ctx, byte = (x.astype(np.int64)[:, None] for x in turned(code))
        level = np.arange(8)
        place, bit = (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1
        for d, key, n, n1, stop in self.nodes:
            if len(key):
                k = ((ctx >> 8 * (DEPTH - d)) << 8) | place
                at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                q = mixed(q, bit, np.where(key[at] == k, n[at], 0), n1[at], stop[at])
        return np.log10(np.where(np.isnan(q), 0.5, q)).sum(axis=1)  # nothing was learned: every bit is even


def window_logs(windows: DataFrame, width: int) -> DataFrame:
    """key, n, log for each distinct window of (key, n, seen): how often it was seen, and the log10 of its last byte's probability by all nodes."""
    parts = written(subtrees(windows, width), "subtrees")
    sums = parts.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum("log").alias("under")).orderBy("key").toArrow()
    upper = windows.sparkSession.sparkContext.broadcast(Upper(*(np.asarray(sums[c]) for c in ("key", "n", "n1", "under"))))

    def finish(batches):
        for b in batches:
            if b.num_rows:
                q = np.frombuffer(b"".join(b.column(2).to_pylist()), "<f4").reshape(-1, 8).astype(float)
                log = upper.value.logs(np.asarray(b.column(0)).view(_U), q)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(log)], ["key", "n", "log"])

    return written(parts.where("kind = 1").select("key", "n", "part").mapInArrow(bare(finish), "key long, n long, log double"), "window-logs")


class Table:
    """Look up 64-bit keys: sorted, with a directory of their hashed top bits."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        h = self._hash(keys.astype(_U))
        self.by = np.argsort(h).astype(np.int32)
        self.h, self.shift = h[self.by], _U(64 - bits)
        self.first = np.searchsorted(self.h >> self.shift, np.arange((1 << bits) + 1).astype(_U)).astype(np.int32)

    @staticmethod
    def _hash(k: np.ndarray) -> np.ndarray:
        k = k * _U(0x9E3779B97F4A7C15)
        return (k ^ (k >> _U(29))) * _U(0xBF58476D1CE4E5B9 | 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the given order, or -1. Distinct keys have distinct hashes (both steps are one-to-one)."""
        h = self._hash(keys.astype(_U))
        top = (h >> self.shift).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < stop)
        at, stop, h = at[live], stop[live], h[live]
        while len(live):
            hit = self.h[at] == h
            out[live[hit]] = self.by[at[hit]]
            at = at + 1
            go = ~hit & (at < stop)
            live, at, stop, h = live[go], at[go], stop[go], h[go]
        return out


class Model:
    """The nodes of all depths in one table: the plain version for small inputs, which the tests hold the scores against."""

    def __init__(self, depth: np.ndarray, key: np.ndarray, kt: np.ndarray, stop: np.ndarray, word: np.ndarray, word_n: np.ndarray, all_words_held: bool):
        self.depth, self.key, self.kt, self.stop = depth.astype(np.int8), key.astype(np.int64), kt.astype(np.float32), stop.astype(np.float32)
        self.word, self.word_n, self.all_words_held = word, word_n, all_words_held
        self.name = np.random.default_rng().integers(1 << 62)

    def open(self) -> Model:
        self.nodes = Table(self.key.astype(_U) | (self.depth.astype(_U) << _U(56)))
        return self

    def window_logs(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte after its context."""
        if not len(self.key):  # nothing was learned: every bit is even
            return np.full(len(code), 8 * np.log10(0.5))
        ctx, byte = turned(code)
        byte = byte.astype(np.int64)
        total = np.zeros(len(code))
        for level in range(8):
            place = (1 << level) | (byte >> (8 - level))
            p, have = np.full(len(code), 0.5), np.zeros(len(code), bool)
            for depth in range(DEPTH, -1, -1):
                at = self.nodes.find(((ctx >> _U(8 * (DEPTH - depth))) << _U(8)) | place.astype(_U) | (_U(depth) << _U(56)))
                there = at >= 0
                kt, stop = self.kt[at].astype(float), self.stop[at].astype(float)
                p = np.where(there, np.where(have, stop * kt + (1 - stop) * p, kt), p)
                have |= there
            total += np.log10(np.where((byte >> (7 - level)) & 1, p, 1 - p))
        return total


class Held:
    """The broadcast part: logs of the most counted windows, and the most counted words."""

    def __init__(self, window: np.ndarray, log: np.ndarray, word: np.ndarray, word_n: np.ndarray):
        self.window, self.log, self.word, self.word_n = window, log, word, word_n
        self.name = np.random.default_rng().integers(1 << 62)

    def open(self) -> Held:
        self.windows, self.words = Table(self.window), Table(self.word)
        self.gram, self.logp = np.full(1 << 20, ~_U(0), _U), np.zeros(1 << 20)
        return self

    def logs(self, code: np.ndarray) -> np.ndarray:
        """The log10 of each window, NaN where it isn't held. What was looked up before is kept in a table of fixed size."""
        at = ((code * _U(0x9E3779B97F4A7C15)) >> _U(44)).astype(np.int64)
        out = self.logp[at]
        miss = np.flatnonzero(self.gram[at] != code)
        if len(miss):
            new, back = np.unique(code[miss], return_inverse=True)
            where = self.windows.find(new)
            got = np.where(where >= 0, self.log[where], np.nan) if len(self.log) else np.full(len(new), np.nan)
            slot = ((new * _U(0x9E3779B97F4A7C15)) >> _U(44)).astype(np.int64)
            self.gram[slot], self.logp[slot] = new, got
            out[miss] = got[back]
        return out


def opened(held: Held) -> Held:
    return worker_model(("ctw", held.name), held.open)


def _threshold(counts: DataFrame, most: int) -> int:
    """The least count such that at most `most` rows have it or more. The histogram has as many rows as distinct counts up to 2**16, and above that one for each power of two."""
    n = F.col("n")
    step = F.when(n < 65536, n).otherwise(F.pow(2.0, F.floor(F.log2(n.cast("double")))).cast("long"))
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in rows:
        total += r.rows
        if total > most:
            return least if least is not None else r.step * 2
        least = r.step
    return least or 1


def fit(gathered: DataFrame, max_nodes: int, max_words: int, width: int) -> Model:
    """The plain version: the `max_nodes` most counted nodes at most. score_documents() needs no such bound."""
    words_, windows = gathered.where("kind = 0"), gathered.where("kind = 1")
    least_word = _threshold(words_, max_words)
    held = words_.where(F.col("n") >= least_word).select("key", "n").toArrow()
    nodes = written(trees(windows, width), "trees")
    least = _threshold(nodes, max_nodes)
    kept = nodes.where(F.col("n") >= least).select("depth", "key", "n", "n1", "stop").toArrow()
    # depths 1 and 0 have at most 256 x 255 and 255 nodes
    upper = nodes.where("depth = 2").groupBy(F.expr("(key >> 16 << 8) | (key & 255)").alias("key")).agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum("log").alias("under")).orderBy("key").toArrow()
    depth, key, n, n1, stop = ([np.asarray(kept[c])] for c in ("depth", "key", "n", "n1", "stop"))
    k, t, o, under = (np.asarray(upper[c]) for c in ("key", "n", "n1", "under"))
    for d in (1, 0):
        own = log_kt(t - o, o)
        both = np.logaddexp(own, under) + np.log(0.5)
        for to, x in ((depth, np.full(len(k), d)), (key, k), (n, t), (n1, o), (stop, np.exp(np.log(0.5) + own - both))):
            to.append(x)
        if d:
            up, at = np.unique((k >> 16 << 8) | (k & 255), return_inverse=True)
            add = lambda x: np.bincount(at, weights=x, minlength=len(up))  # noqa: E731, B023
            k, t, o, under = up, add(t).astype(np.int64), add(o).astype(np.int64), add(both)
    n, n1 = np.concatenate(n), np.concatenate(n1)
    return Model(np.concatenate(depth), np.concatenate(key), (n1 + 0.5) / (n + 1.0), np.concatenate(stop), np.asarray(held["key"]).view(_U), np.asarray(held["n"]), least_word <= 1)


# ------------------------------------------------------------------ scoring


def score_documents(docs: DataFrame, held_out: Column | None = None, max_windows: int = 1 << 20, max_words: int = 1 << 19) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (coded, with the end sign) and bits_per_byte, the code
    length per byte, for each row; learns from the rows that are not held out.

    max_windows, max_words: how many windows and words are broadcast at most; the results don't depend on them."""
    spark = docs.sparkSession
    shared_dir(spark)
    held = held_out if held_out is not None else fold(F.col("doc_id"), 7) == 2
    rows = docs.select(F.col("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    gathered = written(gather(rows.where(~F.col("held_out"))), "counts")
    totals = {r.kind: (r.n, r.v) for r in gathered.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    ends = totals.get(2, (0, 0))[0]
    tokens, distinct = totals.get(0, (0, 0))[0] + ends, totals.get(0, (0, 0))[1] + (ends > 0)
    others = written(gather(rows.where(F.coalesce("held_out", F.lit(True)))).where("kind = 1"), "other-counts")
    windows = gathered.where("kind = 1").select("key", "n", F.col("n").alias("seen")).unionByName(others.select("key", F.lit(0).cast("long").alias("n"), F.col("n").alias("seen")))
    logs = window_logs(windows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = gathered.where("kind = 0").select("key", "n")
    least_window, least_word = _threshold(logs, max_windows), _threshold(counted, max_words)
    some, common = logs.where(F.col("n") >= least_window).select("key", "log").toArrow(), counted.where(F.col("n") >= least_word).toArrow()
    model = spark.sparkContext.broadcast(Held(np.asarray(some["key"]).view(_U), np.asarray(some["log"]), np.asarray(common["key"]).view(_U), np.asarray(common["n"])))
    all_words_held, all_windows_held = least_word <= 1, least_window <= 1
    log_end = float(np.log10(ends + 1.0))

    def score(batches):
        m, part, at = opened(model.value), TaskContext.get().partitionId(), 0
        log_n = np.log10(m.word_n + 1.0)
        for b in batches:
            for start, block, off in slices(b.column(2), RUN):
                low = LOWER[block]
                starts, ends_, first = words(low, off)
                code, stop = coded(low, off, starts, ends_)
                log = m.logs(code)
                absent = np.flatnonzero(np.isnan(log))
                log[absent] = 0.0
                sums = np.add.reduceat(log, np.concatenate([[0], stop[:-1]]))
                rest, rest_cut = code[absent].view(np.int64), np.searchsorted(absent, np.concatenate([[0], stop]))
                h = word_hashes(low, starts, ends_)
                where = m.words.find(h)
                known = where >= 0
                row = np.repeat(np.arange(len(off) - 1), np.diff(first))
                n = len(off) - 1
                base = np.bincount(row, weights=np.where(known, log_n[where] if len(log_n) else 0.0, 0.0), minlength=n) + log_end
                n_known = np.bincount(row[known], minlength=n) + (ends > 0)
                if all_words_held:
                    rare, cut = np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
                else:
                    rare = h[~known].view(np.int64)
                    cut = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=n))])
                key = (np.int64(part) << 40) + at + np.arange(n)
                at += n
                for a in range(0, n, 2000):
                    z = min(n, a + 2000)
                    tail = pa.ListArray.from_arrays(pa.array((rest_cut[a : z + 1] - rest_cut[a]).astype(np.int32)), pa.array(rest[rest_cut[a] : rest_cut[z]]))
                    lists = pa.ListArray.from_arrays(pa.array((cut[a : z + 1] - cut[a]).astype(np.int32)), pa.array(rare[cut[a] : cut[z]]))
                    yield pa.RecordBatch.from_arrays([pa.array(key[a:z]), b.column(0).slice(start + a, z - a), b.column(1).slice(start + a, z - a), pa.array(np.diff(first)[a:z] + 1), pa.array(n_known[a:z].astype(np.int64)), pa.array(base[a:z]), pa.array(sums[a:z]), pa.array(np.diff(stop, prepend=0)[a:z]), lists, tail], ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes", "rare", "tail"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = written(rows.mapInArrow(score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long, rare array<long>, tail array<long>"), "scores")
    # words beyond the broadcast ones: occurrences meet their counts by hash
    rare = scored.select("row", F.explode("rare").alias("key"))
    found = rare.join(gathered.where("kind = 0").select("key", "n"), "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    # and windows beyond the broadcast ones their logs
    tail = scored.select("row", F.explode("tail").alias("key")).join(logs.select("key", "log"), "key").groupBy("row").agg(F.sum("log").alias("tail_logs"))
    norm = float(np.log10(tokens + 1.0 * (distinct + 1)))
    both = scored.drop("rare", "tail").join(found, "row", "left")
    both = both.withColumn("tail_logs", F.lit(0.0)) if all_windows_held else both.join(tail, "row", "left")
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("score") + F.coalesce("tail_logs", F.lit(0.0))).alias("score"), "n_bytes").withColumn("bits_per_byte", -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes"))
