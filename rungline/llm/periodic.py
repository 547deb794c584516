"""Operator 13, periodic runs of words by Karp-Miller-Rosenberg naming.

Arrow numbers the distinct words of some texts exactly. Names of stretches of 2, 4, 8 ... words are then made from pairs of names of half
the length; a stretch that stands only once in its text gets no name, so all but repeated passages drop out after a few levels. A run of
period q holds x[i] = x[i + q] over so long a stretch that some window of a power of two words, at a multiple of its length, lies wholly in
it: only windows on that grid are compared with their neighbours at distance q. Each hit is extended to both sides by descending name
levels, which gives the longest common extensions without hashes or suffix sorting. Of runs of the same words the smallest period counts.

Row by row, so no shuffle: a text needs about 4 bytes a word and level, and levels end where nothing repeats any more. Null texts have no
words and no runs; rows with null or repeated doc_id are treated like any other; a very long text counts whole; an empty table gives no
rows; other columns, whatever their names, are left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, slices, words

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_CELLS = 1 << 20


def word_names(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    inside = np.zeros(len(block) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    kept = block[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return np.asarray(column.dictionary_encode().indices).astype(np.int64)


def _named(keys: np.ndarray) -> np.ndarray:
    """Names of the keys that stand more than once; -1 for the others."""
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(times[at] > 1, at, -1).astype(np.int32)


def name_levels(names: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1 ...: the names of the 2^k words from each place on, -1 where they stand only once in their text.

    Words of different texts get different names, so no stretch equals one of another text or one that leaves its text."""
    n = len(names)
    if not n:
        return []
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    levels = [_named(row * (int(names.max()) + 1) + names)]
    half = 1
    while half < n:
        last = levels[-1]
        at = np.flatnonzero(last[:-half] >= 0)
        at = at[last[at + half] >= 0]
        now = np.full(n, -1, np.int32)
        now[at] = _named(last[at].astype(np.int64) * n + last[at + half])
        if not (now >= 0).any():
            break
        levels.append(now)
        half *= 2
    return levels


def _extent(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i and j on (or before them) are the same, for i < j. No level above the last holds equal stretches."""
    n, out = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        a, b = (i - out - size, j - out - size) if back else (i + out, j + out)
        there = (a >= 0) & (b < n)
        x = levels[k][np.where(there, a, 0)]
        out += size * (there & (x >= 0) & (x == levels[k][np.where(there, b, 0)]))
    return out


def find_runs(names: np.ndarray, first: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods (in order of start, then period) of all runs of at least max(least, times * period) words, times >= 2.

    names numbers the words of texts that lie one after the other, text r from first[r] on."""
    levels = name_levels(names, first)
    none = np.zeros(0, np.int64)
    sizes = np.diff(first)
    q = np.arange(1, (int(sizes.max()) if len(sizes) else 0) // times + 1)
    stretch = np.maximum(least - q, (times - 1) * q)  # so many places i in a row have x[i] = x[i + q], at least
    level = np.frexp((stretch + 1) // 2)[1] - 1  # the largest window of which one on the grid lies wholly in them
    found = []
    for k in range(len(levels)):
        here = q[level == k]
        grid = np.arange(0, len(names), 1 << k)
        grid = grid[levels[k][grid] >= 0]
        if not len(here) or not len(grid):
            continue
        step = max(1, _CELLS // len(here))
        hits = []
        for c in range(0, len(grid), step):
            g = grid[c : c + step, None]
            to = g + here
            same = (levels[k].take(to, mode="clip") == levels[k][g]) & (to < len(names))
            m, p = np.nonzero(same)
            hits.append((grid[c + m], here[p]))
        at, period = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        fresh = np.ones(len(at), bool)  # a hit that goes on from the window before is of the same run
        fresh[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + (1 << k))
        at, period = at[fresh], period[fresh]
        left = _extent(levels, at, at + period, True)
        right = _extent(levels, at, at + period, False)
        length = left + right + period
        long = length >= np.maximum(least, times * period)
        found.append((at[long] - left[long], length[long], period[long]))
    if not found:
        return none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(block: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of the kept words, joined by one space in each row."""
    w = np.flatnonzero(kept)
    row = np.searchsorted(first, w, "right")
    edge = np.zeros(len(block) + 1, np.int8)
    edge[starts[w]] += 1
    edge[ends[w]] -= 1
    mask = np.cumsum(edge, dtype=np.int8).view(bool)[:-1]
    out = block.copy()
    gap = ends[w[:-1][row[:-1] == row[1:]]]  # white space follows in the row, as another kept word does
    out[gap] = 0x20
    mask[gap] = True
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return out[mask], total[off]


def runs_of(block: np.ndarray, off: np.ndarray, least: int, times: int) -> pa.RecordBatch:
    starts, ends, first = words(block, off)
    start, length, period = find_runs(word_names(block, starts, ends), first, least, times)
    row = np.searchsorted(first, start, "right") - 1
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    text, at = _collapsed(block, off, starts, ends, first, np.cumsum(edge[:-1]) == 0)
    lists = np.searchsorted(row, np.arange(len(off))).astype(np.int32)
    item = pa.StructArray.from_arrays([pa.array(start - first[row]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    column = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(text)])
    return pa.RecordBatch.from_arrays([pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(lists), item), column.cast(pa.string())], ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period), collapsed for each row. A run is a longest stretch
    with smallest period q, of at least max(least, times * q) words; collapsed has the words that are in no run after its first q words,
    joined by one space."""

    def run(batches):
        for b in batches:
            for at, block, off in slices(b.column(1)):
                out = runs_of(block, off, least, times)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, out.num_rows), *out.columns], ["doc_id", *out.schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(bare(run), f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def most_repeated(runs: str = "runs") -> Column:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period. Null without runs."""
    better = "r.length * m.period > m.length * r.period OR (r.length * m.period = m.length * r.period AND (r.start < m.start OR (r.start = m.start AND r.period < m.period)))"
    return F.expr(f"aggregate({runs}, get({runs}, 0), (m, r) -> CASE WHEN {better} THEN r ELSE m END)")


def with_planted_run(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a run put into one document in ten: from word a = g % n on, its words repeat with period
    1 + floor((n - a) / (3 + g % 8)), where h = crc32(doc_id as text) = 10 g + 0. Its words are then joined by one space."""
    text = F.col("text").cast("string")
    df = docs.select("doc_id", text.alias("text"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    list_ = F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"))
    df = df.withColumn("w", list_).withColumn("a", F.expr("cast(CASE WHEN size(w) > 0 THEN (h div 10) % size(w) END AS int)"))
    df = df.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + (h div 10) % 8) AS int)"))
    planted = F.expr("array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[a + (i - a) % p] END), ' ')")
    return df.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
