"""Operator 10, near-duplicates by HyperMinHash.

A text's words (A-Z lower-cased) give its set of distinct five-word shingles, held as 64-bit hashes; a text of fewer words is one shingle.
Texts with equal sets are one class (by a 128-bit digest of the set) and their least row stands for them. Each class has a HyperMinHash
sketch: hashes are dealt to buckets, and a bucket keeps its least hash as the number of leading zeros and ten more bits, 16 bits in all;
empty buckets borrow from others by a fixed draw. Runs of registers form bands, and classes that agree in a band are candidates. The
share of agreeing registers, corrected for chance agreement, estimates their similarity; pairs that can't reach the threshold go, and
the rest are confirmed on their full sets.

Candidate groups are not expanded into pairs. First each class is tried against the best of a few common partners (the least
classes of its groups), which joins most of a large group into one component. Then, in groups that still hold several components,
members of different components are compared by sketch, in blocks of bounded size; a pair is looked at in the first band that it shares.
Members with a promising partner meet once more with their full sets, and each block confirms what can still join two of its components
and returns those links alone, fewer than its members. A link inside a component doesn't change the result. A link between components is
found if its texts share a band and their estimate is within `slack` of the threshold: at a similarity of 0.85 all 32 bands miss with a
chance of 7e-9, at 0.80 of 3e-6, and an estimate falls short by `slack` with one of about 4e-8; measured recall against brute force is 1.

Null and empty texts have no shingles and link with nothing. Rows with a null doc_id take no part: component_id is null and kept is true.
Rows that repeat a doc_id are linked by their texts; `first` marks one row of each component, also among repeated rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bare, free_names, mix64, shingle_hashes, shuffle_width, slices, word_hashes, words, worker_model, written
from .components import connected_components

BANDS, PER_BAND = 32, 5
REGISTERS = BANDS * PER_BAND
MANTISSA = 10
_U = np.uint64
#: where an empty register looks, in order
_DRAWS = (mix64(np.arange(256 * REGISTERS, dtype=np.uint64) + _U(12345)) % _U(REGISTERS)).astype(np.int64).reshape(256, REGISTERS)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of hashes (not empty)."""
    scaled = (hashes >> _U(32)) * _U(REGISTERS)
    bucket = (scaled >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # hashes are sorted: the first is the bucket's least
    rest = ((scaled[first] & _U(0xFFFFFFFF)) << _U(32)) | (hashes[first] & _U(0xFFFFFFFF))
    m, e = np.frexp(np.maximum(rest, _U(1)).astype(float))
    zeros = np.clip(64 - e, 0, 63)
    kept = (zeros << MANTISSA) | np.minimum(((m * 2 - 1) * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)
    out, there = np.zeros(REGISTERS, np.int64), np.zeros(REGISTERS, bool)
    out[bucket[first]], there[bucket[first]] = kept, True
    empty = np.flatnonzero(~there)
    if len(empty):
        ok = there[_DRAWS[:, empty]]
        step = ok.argmax(axis=0)
        source = _DRAWS[step, empty]
        none = ~ok[step, np.arange(len(empty))]
        if none.any():  # all draws missed: the next register that has a value
            have = np.flatnonzero(there)
            source[none] = have[np.searchsorted(have, empty[none]) % len(have)]
        out[empty] = out[source]
    return out.astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """rows x BANDS keys."""
    r = registers.reshape(-1, BANDS, PER_BAND).astype(_U)
    h = np.broadcast_to(np.arange(BANDS, dtype=_U), r.shape[:2]).copy()
    for j in range(PER_BAND):
        h = mix64(h * _U(0x9E3779B97F4A7C15) + r[:, :, j])
    return h.view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of unlike sets of n and m shingles agree: equal leading zeros, by each set's share a bucket, and equal mantissas."""
    z = np.arange(40)
    near = lambda x: np.exp(-np.maximum(x / REGISTERS, 1.0)[:, None] * 2.0 ** -(z + 1)) - np.exp(-np.maximum(x / REGISTERS, 1.0)[:, None] * 2.0**-z)
    return np.abs(near(n) * near(m)).sum(axis=1) / (1 << MANTISSA)


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    c = chance(n.astype(float), m.astype(float))
    return (agree / REGISTERS - c) / (1 - c)


def _sets(column, width: int):
    """(row, sorted shingle hashes) for each row of an Arrow text column."""
    for start, block, off in slices(column):
        low = LOWER[block]
        starts, ends, first = words(low, off)
        h = word_hashes(low, starts, ends)
        for k in range(len(off) - 1):
            yield start + k, shingle_hashes(h, first[k], first[k + 1], width)


def describe(docs: DataFrame, width: int = 5) -> DataFrame:
    """rid, doc_id, text_hash, n_shingles, digest, registers for each row. rid is the row's number, the same only within one run: write the table before use."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n, digest, regs = np.zeros(b.num_rows, np.int64), [None] * b.num_rows, [None] * b.num_rows
            for k, s in _sets(b.column(2), width):
                n[k] = len(s)
                if len(s):
                    digest[k] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    regs[k] = sketch(s).tobytes()
            rid = (np.int64(part) << 36) + at + np.arange(b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rid), b.column(0), b.column(1), pa.array(n), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["rid", "doc_id", "text_hash", "n_shingles", "digest", "registers"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(bare(run), "rid long, doc_id long, text_hash long, n_shingles long, digest binary, registers binary")


def _agreement(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """pairs(a, b) with their estimate, where it is at least `least`."""
    side = lambda x: classes.select(F.col("rid").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in ("ra", "rb"))
                e = estimate((x == y).sum(axis=1), np.asarray(b.column("na")), np.asarray(b.column("nb")))
                t = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(e)], ["a", "b", "estimate"])
                yield t.filter(pa.array(e >= least))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(bare(run), "a long, b long, estimate double")


def _full_sets(rids: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """rid, shingles for the classes in `rids`, made again from the texts of their rows and written."""
    wanted = rids.select("rid").distinct().join(classes.select("rid", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")), "rid")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    found = texts.join(wanted, (F.col("doc_id") == F.col("__id")) & (F.col("h") == F.col("__h"))).select("rid", "text")

    def build(batches):
        for b in batches:
            for k, s in _sets(b.column(1), width):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([s.tobytes()], pa.binary())], ["rid", "shingles"])

    return written(found.mapInArrow(bare(build), "rid long, shingles binary").groupBy("rid").agg(F.first("shingles").alias("shingles")), "sets")


def similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets (not empty)."""
    if len(u) > len(v):
        u, v = v, u
    at = np.searchsorted(v, u)
    both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
    return 100 * both >= percent * (len(u) + len(v) - both)


def _confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs(a, b) that are linked by their full sets."""
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("rid")), docs, classes, width)

    def check(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), percent) for x, y in zip(b.column("sa"), b.column("sb"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: sets.select(F.col("rid").alias(x), F.col("shingles").alias(f"s{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(bare(check), "a long, b long")


def agreeing(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many registers of each row equal those of `one`: eight flags are added at a time, as bytes of a long (a byte holds up to 255)."""
    lanes = (many == one).view("<u8").sum(axis=1, dtype=_U)
    return ((lanes * _U(0x0101010101010101)) >> _U(56)).astype(np.int64)


class Block:
    """Members of one candidate group: two blocks of it, or one against itself."""

    def __init__(self, pdf: pd.DataFrame, percent: int, least: float):
        worker_model(None)
        self.rid, self.comp, self.n = (pdf[c].to_numpy() for c in ("rid", "component", "n_shingles"))
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        side = pdf["at"].to_numpy()
        self.left, self.right, self.same = np.flatnonzero(side == i), np.flatnonzero(side == j), i == j
        regs = np.frombuffer(b"".join(pdf.registers), "<u2").reshape(-1, REGISTERS)
        self.keys, self.regs = band_keys(regs), regs
        self.band = int(np.argmax((self.keys == pdf["key"].iloc[0]).all(axis=0)))
        self.percent, self.least = percent, least

    def promising(self):
        """For each member on the left: its place, and places and estimates of partners of other components that it meets here first."""
        for x in self.left:
            y = self.right[(self.comp[self.right] != self.comp[x]) & ((self.rid[self.right] > self.rid[x]) if self.same else True)]
            # sets whose sizes differ too much can't be similar enough
            y = y[np.minimum(self.n[y], self.n[x]) * 100 >= self.percent * np.maximum(self.n[y], self.n[x])]
            if not len(y):
                continue
            agree = agreeing(self.regs[y], self.regs[x])
            some = agree >= self.least * REGISTERS  # the correction only lowers an estimate
            y, agree = y[some], agree[some]
            e = estimate(agree, self.n[y], np.full(len(y), self.n[x]))
            good = np.flatnonzero(e >= self.least)
            good = good[~(self.keys[y[good], : self.band] == self.keys[x, : self.band]).any(axis=1)]
            if len(good):
                yield x, y[good], e[good]


def _joining(block: Block, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join the block's components, likeliest first; a pair within one component by then is not looked at."""
    root = {c: c for c in block.comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for x, ys, es in block.promising():
        for y in ys[np.argsort(-es)]:
            a, b = find(block.comp[x]), find(block.comp[y])
            if a != b and similar(sets[x], sets[y], percent):
                root[max(a, b)] = min(a, b)
                out.append((int(block.rid[x]), int(block.rid[y])))
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, partners: int = 4, block: int = 1024, block_shingles: int = 2_000_000, slack: float = 0.16) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, first for each row.

    block, block_shingles: about how many members, and how many shingles of theirs, a block of a candidate group holds.
    slack: how far below the threshold an estimate may lie, some 5.5 of its standard deviations (0.16 at 85 %, 0.18 at 80 %)."""
    least = percent / 100 - slack
    table = written(describe(docs, width), "sketches")
    part = table.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # the least doc_id, then the least row, stands for a class
    named = part.groupBy("digest").agg(F.min(F.struct("doc_id", "rid", "text_hash")).alias("s"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = written(named.select("digest", F.col("s.rid").alias("rid"), F.col("s.doc_id").alias("doc_id"), F.col("s.text_hash").alias("text_hash"), "n_shingles", "registers"), "classes")

    def bands(batches):
        for b in batches:
            rid = np.asarray(b.column(0))
            for at in range(0, len(rid), 4000):
                regs = np.frombuffer(b"".join(b.column(1).slice(at, 4000).to_pylist()), "<u2")
                keys = band_keys(regs)
                n = np.asarray(b.column(2))[at : at + 4000]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(rid[at : at + 4000], BANDS)), pa.array(np.repeat(n, BANDS))], ["key", "rid", "n_shingles"])

    banded = classes.select("rid", "registers", "n_shingles").mapInArrow(bare(bands), "key long, rid long, n_shingles long")
    groups = banded.groupBy("key").agg(F.min("rid").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    shared = written(banded.join(groups, "key"), "bands")

    # stars: the best of a few common partners
    few = shared.where("rid <> pivot").select("rid", "pivot").distinct().groupBy("rid").agg(F.slice(F.array_sort(F.collect_set("pivot")), 1, partners).alias("p"))
    stars = _agreement(few.select(F.col("rid").alias("b"), F.explode("p").alias("a")).select("a", "b"), classes, least)
    best = stars.groupBy("b").agg(F.max(F.struct("estimate", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    links = written(_confirm(best, docs, classes, width, percent), "star-links")
    joined = connected_components(links)

    # what is left: members of different components in one group
    placed = shared.select("key", "rid", "n_shingles").join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    size = F.greatest(F.count("*") / F.lit(block), F.sum("n_shingles") / F.lit(block_shingles))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(size).cast("int").alias("blocks")).where("low < high").select("key", "blocks")
    at = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = placed.drop("n_shingles").join(mixed, "key").withColumn("at", at).withColumn("other", other).select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "rid", "component")
    spread = spread.join(classes.select("rid", "n_shingles", "registers"), "rid")

    def involved(pdf: pd.DataFrame) -> pd.DataFrame:
        b, there = Block(pdf, percent, least), np.zeros(len(pdf), bool)
        for x, y, _ in b.promising():
            there[x] = there[y] = True
        return pdf.loc[there, ["key", "i", "j", "at", "rid", "component", "n_shingles", "registers"]]

    def joining(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_joining(Block(pdf, percent, least), [np.frombuffer(x, _U) for x in pdf.shingles], percent), columns=["a", "b"], dtype=np.int64)

    group = ["key", "i", "j"]
    width_ = shuffle_width(docs.sparkSession)  # blocks are small in bytes and long to compare: no two tasks are joined
    open_ = written(spread.repartition(width_, *group).groupBy(*group).applyInPandas(involved, "key long, i int, j int, at int, rid long, component long, n_shingles long, registers binary"), "open")
    sets = _full_sets(open_, docs, classes, width)
    more = open_.join(sets, "rid").repartition(width_, *group).groupBy(*group).applyInPandas(joining, "a long, b long")
    found = links.select("a", "b").unionByName(written(more, "links"))
    whole = connected_components(found)

    # back to all rows: written tables on both sides, so that a large component or group of copies can be split over tasks
    member = classes.select("digest", "rid", "doc_id").join(whole.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    lowest = written(member.groupBy("component").agg(F.min(F.struct("doc_id", "rid")).alias("low")), "lowest")
    class_of = written(member.select("digest", "component").join(lowest, "component").select("digest", "low"), "class-of")
    rows = table.drop("registers").withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))).join(class_of, "digest", "left")
    own = F.coalesce(F.col("low.doc_id"), F.col("doc_id"))
    first = F.coalesce(F.col("low.rid"), F.col("rid")) == F.col("rid")
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "text_hash", first.alias("first"))


def keep_first(docs: DataFrame, percent: int = 85, width: int = 5, slack: float = 0.16) -> DataFrame:
    """One row of docs, with all its columns, for each component; rows without shingles or doc_id all stay. Of rows that repeat both doc_id and text one stays."""
    id_, hash_, n, own = free_names(docs, "__id", "__hash", "__n", "__own")
    kept = near_duplicates(docs, percent, width, slack=slack).where("first").groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.max("n_shingles").alias(n))
    rows = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_)), "inner")
    whole = rows.where((F.col(n) == 0) | F.col(id_).isNull()).select(*docs.columns)
    once = rows.where((F.col(n) > 0) & F.col(id_).isNotNull()).dropDuplicates([id_, hash_]).select(*docs.columns)
    return once.unionByName(whole)
