"""Adaptive context-mixing range coder for token ids.

A block is coded by itself: its tables start empty and its ids carry a CRC-32. Its tokens are dealt to up to 8192 lanes, equal runs of
the block; all lanes advance together, one token a step, and share the tables, so a step is a few array operations. For each token the
order-2 and order-1 tables each predict one id with a confidence. Adaptive counts for each pair of confidences mix four outcomes: the
order-2 id, the order-1 id, an id by the adaptive order-0 distribution, or an id that this block hasn't had (uniform). The outcome, and
for the last two the id, drive a range coder with 48 bits of state and carries resolved at the block's end."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RLID"
_HEAD = struct.Struct("<4sIQQII")  # magic, documents, tokens, doc index bytes, lanes, crc32
_TOTAL, _TOP, _MASK = 1 << 16, 1 << 32, (1 << 32) - 1
_HASH_BITS = 18
_LANES, _LEAST_STEPS = 8192, 256
VOCABULARY = 1 << 16


class _Model:
    """What encoder and decoder both know after each step. A table's entry is an id and its confidence 1..7, or 0: id * 8 + confidence."""

    def __init__(self, lanes: int):
        self.table2, self.table1 = np.zeros(1 << _HASH_BITS, np.int32), np.zeros(VOCABULARY, np.int32)
        self.outcomes = np.ones(512, np.int64)
        self.outcomes[2::4] += 2
        self.counts = np.zeros(VOCABULARY, np.int64)
        self.fresh: list[np.ndarray] = []
        self.step, self.due = 0, 1
        self.p1 = self.p2 = np.zeros(lanes, np.int32)
        self._order0()
        self._mix()

    def _order0(self) -> None:
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=VOCABULARY)
            self.fresh = []
        seen = np.flatnonzero(self.counts)
        self.f0, self.c0 = np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.int64)
        self.by_slot = np.zeros(_TOTAL, np.int32)
        if len(seen):
            c = self.counts[seen]
            f = 1 + c * (_TOTAL - len(seen)) // c.sum()
            f[np.argmax(f)] += _TOTAL - f.sum()
            self.f0[seen], self.c0[seen] = f, np.cumsum(f) - f
            self.by_slot = np.repeat(seen.astype(np.int32), f)

    def _mix(self) -> None:
        """Where each outcome's share of the range begins (and its end), by context: 5 entries each."""
        above = np.cumsum(self.outcomes.reshape(128, 4), axis=1)
        edges = np.zeros((128, 5), np.int64)
        edges[:, 1:] = above * (_TOTAL - 4) // above[:, 3:] + np.arange(1, 5)
        self.edges = edges.ravel()

    def look(self) -> np.ndarray:
        self.at2 = (self.p2.astype(np.uint32) * np.uint32(0x9E3779B1) ^ self.p1.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _HASH_BITS)
        self.t2, self.t1 = self.table2.take(self.at2), self.table1.take(self.p1)
        self.g2, self.g1 = self.t2 >> 3, self.t1 >> 3
        self.ctx = (self.t2 & 7) * 16 + (self.t1 & 7) * 2 + (self.g1 == self.g2)
        return self.ctx

    @staticmethod
    def _next(t: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> np.ndarray:
        k = t & 7
        return np.where(hit, t + (k < 7), np.where(k > 1, t - (k - (k >> 1)), ids * 8 + 1))

    def learn(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        self.outcomes += np.bincount(self.ctx * 4 + outcome, minlength=512)
        self.table2[self.at2] = self._next(self.t2, self.g2 == ids, ids)
        self.table1[self.p1] = self._next(self.t1, self.g1 == ids, ids)
        self.fresh.append(ids)
        self.p2, self.p1 = self.p1, ids
        self.step += 1
        if self.step < 64 or self.step % 4 == 0:
            self._mix()
        if self.step == self.due:
            self._order0()
            self.due = self.step * 2 if self.step < 16 else self.step + 16


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(_LANES, n // _LEAST_STEPS))
    return lanes, -(-n // lanes)


def _encode_ids(ids: np.ndarray) -> tuple[int, bytes]:
    lanes, steps = _lanes(len(ids))
    grid = np.zeros(lanes * steps, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
    digits, pos = np.zeros((2 * steps + 4) * lanes, np.int32), np.arange(lanes)  # a lane's digits stand `lanes` apart
    model = _Model(lanes)

    def put(at, start, size):
        """at: lanes, or a slice of all."""
        r = rng[at] >> 16
        lo, rn = low[at] + r * start, r * size
        small = np.flatnonzero(rn < _TOP)
        j = small if isinstance(at, slice) else at[small]
        at_small = lo.take(small)
        place = pos.take(j)
        digits[place] = at_small >> 32
        pos[j] = place + lanes
        lo[small] = (at_small & _MASK) << 16
        rn[small] <<= 16
        low[at], rng[at] = lo, rn

    for x in grid:
        ctx = model.look()
        outcome = np.where(model.g2 == x, 0, np.where(model.g1 == x, 1, np.where(model.f0.take(x) > 0, 2, 3)))
        edge = ctx * 5 + outcome
        start = model.edges.take(edge)
        put(slice(None), start, model.edges.take(edge + 1) - start)
        if len(j := np.flatnonzero(outcome == 2)):
            put(j, model.c0.take(x[j]), model.f0.take(x[j]))
        if len(j := np.flatnonzero(outcome == 3)):
            put(j, x[j], np.ones(len(j), np.int64))
        model.learn(x, outcome)
    for part in (low >> 32, (low >> 16) & 0xFFFF, low & 0xFFFF):
        digits[pos] = part
        pos += lanes
    digits, pos = digits.reshape(-1, lanes), pos // lanes
    for k in range(int(pos.max()) - 1, 0, -1):
        digits[k - 1] += digits[k] >> 16
        digits[k] &= 0xFFFF
    used = np.arange(len(digits))[:, None] < pos
    return lanes, pos.astype("<u4").tobytes() + digits.T[used.T].astype("<u2").tobytes()


def _decode_ids(n: int, lanes: int, coded: memoryview) -> np.ndarray:
    steps = -(-n // lanes)
    size = np.frombuffer(coded[: 4 * lanes], "<u4").astype(np.int64)
    digits = np.concatenate([np.frombuffer(coded[4 * lanes :], "<u2").astype(np.int64), np.zeros(4, np.int64)])
    at = np.cumsum(size) - size
    dif = digits[at] << 32 | digits[at + 1] << 16 | digits[at + 2]
    at = at + 3
    rng = np.full(lanes, (1 << 48) - 1, np.int64)
    model, grid = _Model(lanes), np.empty((steps, lanes), np.int32)

    def slot(where):
        r = rng[where] >> 16
        if not r.all():  # an undamaged block never gets here
            raise ValueError("range is used up")
        return r, np.minimum((dif[where] / r).astype(np.int64), _TOTAL - 1)  # exact: below 2**48, quotients below 2**17

    def take(where, r, start, size):
        df, rn = dif[where] - r * start, r * size
        small = np.flatnonzero(rn < _TOP)
        j = small if isinstance(where, slice) else where[small]
        place = at.take(j)
        df[small] = df.take(small) << 16 | digits.take(place)
        at[j] = place + 1
        rn[small] <<= 16
        dif[where], rng[where] = df, rn

    for k in range(steps):
        ctx = model.look()
        r, v = slot(slice(None))
        edge = ctx * 5
        outcome = (v >= model.edges.take(edge + 1)).astype(np.int32) + (v >= model.edges.take(edge + 2)) + (v >= model.edges.take(edge + 3))
        edge += outcome
        start = model.edges.take(edge)
        take(slice(None), r, start, model.edges.take(edge + 1) - start)
        x = np.where(outcome == 0, model.g2, model.g1)
        if len(j := np.flatnonzero(outcome == 2)):
            r, v = slot(j)
            x[j] = got = model.by_slot.take(v)
            take(j, r, model.c0.take(got), model.f0.take(got))
        if len(j := np.flatnonzero(outcome == 3)):
            r, v = slot(j)
            x[j] = v
            take(j, r, v, np.ones(len(j), np.int64))
        grid[k] = x
        model.learn(x, outcome)
    return grid.T.reshape(-1)[:n]


def _checksum(head: tuple, index, coded, ids) -> int:
    """CRC-32 of the head, the index, the coded bytes and the ids themselves."""
    crc = 0
    for part in (_HEAD.pack(*head, 0), index, coded, np.asarray(ids, "<u4").tobytes()):
        crc = zlib.crc32(part, crc)
    return crc


def encode_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: documents' ids and lengths, then the coded token ids (below 65536)."""
    index = np.array([-1 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.asarray(sizes, "<u4").tobytes()
    lanes, coded = _encode_ids(ids) if len(ids) else (0, b"")
    head = MAGIC, len(doc_ids), len(ids), len(index), lanes
    return _HEAD.pack(*head, _checksum(head, index, coded, ids)) + index + coded


def decode_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The inverse; raises ValueError if the block is not whole."""
    view = memoryview(block)
    if len(view) < _HEAD.size:
        raise ValueError("block too short")
    magic, n_docs, n, index_size, lanes, crc = _HEAD.unpack(view[: _HEAD.size])
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    index, coded = view[_HEAD.size : _HEAD.size + index_size], view[_HEAD.size + index_size :]
    if index_size != 13 * n_docs or len(index) != index_size or lanes > n or (n > 0) != (lanes > 0):
        raise ValueError("damaged block: sizes differ")
    try:
        ids = _decode_ids(n, lanes, coded) if n else np.zeros(0, np.int64)
    except (IndexError, ValueError, MemoryError) as e:
        raise ValueError(f"damaged block: {e}") from e
    out = ids.astype("<u4")
    if _checksum((magic, n_docs, n, index_size, lanes), index, coded, out) != crc:
        raise ValueError("damaged block: checksum differs")
    null = np.frombuffer(index[8 * n_docs : 9 * n_docs], "u1")
    docs = [None if z else int(d) for d, z in zip(np.frombuffer(index[: 8 * n_docs], "<i8"), null, strict=True)]
    return docs, np.frombuffer(index[9 * n_docs :], "<u4"), out
