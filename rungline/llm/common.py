"""Helpers that the operators share: shared folders, written tables, Arrow text buffers and word hashes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets one temporary folder; any other is refused."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-rungline-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/rungline-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_worker: dict = {}


def worker_model(key: tuple | None, make=None):
    """What a worker process holds between tasks: one model at a time, so that operators that follow each other don't add up in its memory.

    Without a key, whatever is held goes. Freed memory is given back to the system."""
    if key is None or key not in _worker:
        _worker.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
        if key is not None:
            _worker[key] = make()
    return _worker.get(key)


def bare(run):
    """A function of batches that holds no model: a worker lets go of what it held before."""

    @functools.wraps(run)
    def first_let_go(batches):
        worker_model(None)
        yield from run(batches)

    return first_let_go


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def least_rows(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The n rows of each group with the least keys (longs spread evenly, as hashes are), ties by the other columns. There must be few groups.

    Keys are first counted in 4096 ranges, which come to the driver; only the ranges that the n least lie in are ranked, so no task meets a
    whole group."""
    at = F.shiftright(key, 52)
    edge: dict = {}
    for r in sorted(df.groupBy(group, at.alias("at")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["at"]):
        last, total = edge.get(r[group], (None, 0))
        edge[r[group]] = (r["at"] if total < n else last, total + r["n"])
    bound = df.sparkSession.createDataFrame([(g, int(x)) for g, (x, _) in edge.items()], f"{group} {df.schema[group].dataType.simpleString()}, __edge int")
    near = df.join(F.broadcast(bound), group).where(at <= F.col("__edge")).drop("__edge")
    place = F.row_number().over(Window.partitionBy(group).orderBy(key, *[c for c in df.columns if c not in (group, key)]))
    return near.withColumn("__k", place).where(F.col("__k") <= n).drop("__k")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(col, buckets: int):
    """crc32 of the id as text, modulo buckets: the contract's deterministic split. A null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


# ---------------------------------------------------------------- Arrow text

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_C = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
_TAIL = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S33
    return h


def slices(column: pa.Array, limit: int = 1 << 20):
    """Cut an Arrow text column into runs of rows of about `limit` bytes (a longer row stands alone): yields (first row, bytes, offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        stop = min(stop, n)
        o = off[start : stop + 1] - off[start]
        block = data[off[start] : off[stop]]
        if not valid[start:stop].all():  # a null may carry bytes; it counts as empty
            size = np.where(valid[start:stop], np.diff(o), 0)
            block = np.concatenate([block[o[i] : o[i + 1]] for i in np.flatnonzero(size)] or [np.zeros(0, np.uint8)])
            o = np.concatenate([[0], np.cumsum(size)])
        yield start, block, o.astype(np.int64)
        start = stop


def words(block: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside 0x20 and 0x09-0x0D, and the place of each row's first word (one more entry than rows)."""
    ns = ~_SPACE[block]
    if not len(ns):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.empty_like(ns)
    before[0] = False
    before[1:] = ns[:-1]
    inner = off[:-1][off[:-1] < len(ns)]
    before[inner] = False
    starts = np.flatnonzero(ns & ~before)
    after = np.empty_like(ns)
    after[-1] = False
    after[:-1] = ns[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(ns & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, eight bytes a step for all words that still have bytes."""
    padded = np.concatenate([block, np.zeros(8, np.uint8)])
    at = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _C[0]
    live, k = np.arange(len(starts)), 0
    while len(live):
        left = size[live] - 8 * k
        part = at[starts[live] + 8 * k] & _TAIL[np.minimum(left, 8)]
        h[live] = mix64((h[live] ^ part) + _C[1])
        live, k = live[left > 8], k + 1
    return h


def shingle_hashes(h: np.ndarray, first: int, last: int, width: int = 5) -> np.ndarray:
    """Distinct sorted hashes of the width-word windows of words first..last; with fewer words, of the whole sequence."""
    n = last - first
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = min(n, width)
    s = np.full(n - w + 1, w, np.uint64)
    for j in range(w):
        s += h[first + j : last - w + 1 + j] * _C[j]
    return np.unique(mix64(s))
