"""Pieces of the word-level vocabulary's pattern in Latin-1 texts, and their ids, by array operations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_DIGIT = 2
#: Of each character: 0 white space, 1 letter, 2 digit, 3 other. Characters whose class differs between pattern engines never come here.
_KIND = np.array([0 if c.isspace() else 1 if c.isalpha() else _DIGIT if c.isdigit() else 3 for c in map(chr, range(256))], np.uint8)
_LOWER = np.frombuffer("".join(c if c == "\xb5" else c.lower() for c in map(chr, range(256))).encode("latin-1"), np.uint8)
#: 's 't 'm 'd are pieces, and so are 'll 're 've
_ONE_MORE, _TWO_MORE = np.zeros(256, bool), np.zeros(256, np.uint8)
_ONE_MORE[list(b"stmd")] = True
_TWO_MORE[list(b"lrv")] = list(b"lee")
#: a piece's first and second eight bytes, by its size
_FIRST = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(16)], np.uint64)
_SECOND = np.array([(1 << 8 * max(k - 8, 0)) - 1 for k in range(16)], np.uint64)
_SHORT = 15


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin and end in lower-case characters, of which the last is white space."""
    kind = _KIND.take(data)
    begins = kind != 0
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    quotes = np.flatnonzero(data == 39)
    quotes = quotes[begins[quotes]]
    if len(quotes):
        after = data[quotes + 1]
        one = quotes[_ONE_MORE[after]]
        two = quotes[_TWO_MORE[after] > 0]
        two = two[data[two + 2] == _TWO_MORE[data[two + 1]]]
        begins[one + 1] = begins[two + 1] = False
        begins[one + 2], begins[two + 3] = kind[one + 2] > 0, kind[two + 3] > 0
    ends = kind[:-1] != 0
    ends &= begins[1:] | (kind[1:] == 0)
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def dealt(ids: np.ndarray, first: np.ndarray, size: np.ndarray, code: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """The ids of each text, as bytes: its pieces are code up to the text's stop, and a piece's ids are `size` from `first`."""
    n = size[code]
    end = np.cumsum(n, dtype=np.int64)
    at = np.repeat((first[code] - (end - n)).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    flat = ids[at].tobytes()
    cut = np.concatenate([[0], end])[np.concatenate([[0], stop])] * 4
    return [flat[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


class WordTable:
    """Ids of pieces, each learned once. Pieces of up to 15 bytes are found by open addressing, many at once: two words hold a piece's bytes and
    its size, so equal words are equal pieces. Longer ones are in a dictionary. Beyond about `keep` bytes the half met last stays."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], keep: int):
        self.learn, self.keep, self.turn = learn, keep, 0
        self._clear()

    def _clear(self) -> None:
        self.n, self.long = 0, {}
        self._entries(1 << 16)
        self.first, self.size, self.last = (np.zeros(1 << 12, np.int32) for _ in range(3))
        self.ids, self.used = np.zeros(1 << 14, "<u4"), 0

    def _entries(self, n: int) -> None:
        """n empty entries, a power of two."""
        self.one, self.two, self.number = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32)

    def held(self) -> int:
        return sum(a.nbytes for a in (self.one, self.two, self.number, self.first, self.size, self.last, self.ids)) + 200 * len(self.long)

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if self.n and self.held() > self.keep:
            self._halve()
        text = "\n".join([*texts, " " * 16])
        data = _LOWER.take(np.frombuffer(text.encode("latin-1"), np.uint8))
        begin, end = bounds(data)
        stop = np.searchsorted(begin, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        try:
            code = self._codes(data, begin, end)
        except BaseException:  # numbers may have been given to pieces without ids
            self._clear()
            raise
        self.turn += 1
        self.last[code] = self.turn
        return dealt(self.ids, self.first, self.size, code, stop)

    def _codes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - begin
        code, short = np.empty(len(begin), np.int32), np.flatnonzero(size <= _SHORT)
        b, n = begin[short], size[short]
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        code[short], new = self._find(eight[b] & _FIRST.take(n), eight[b + 8] & _SECOND.take(n) | n.astype(np.uint64) << np.uint64(56))
        new = short[new].tolist()
        for k in np.flatnonzero(size > _SHORT).tolist():
            piece = data[begin[k] : end[k]].tobytes()
            if piece not in self.long:
                self.long[piece] = self.n
                self.n += 1
                new.append(k)
            code[k] = self.long[piece]
        if new:
            text = data.tobytes().decode("latin-1")
            self._add(self.learn([text[a:z] for a, z in zip(begin[new].tolist(), end[new].tolist(), strict=True)]))
        return code

    def _add(self, got: list[bytes]) -> None:
        """The ids of the pieces numbered last."""
        n = np.fromiter(map(len, got), np.int32, len(got)) >> 2
        self.first, self.size, self.last = (_room(a, self.n) for a in (self.first, self.size, self.last))
        self.size[self.n - len(n) : self.n] = n
        self.first[self.n - len(n) : self.n] = self.used + np.cumsum(n) - n
        ids = np.frombuffer(b"".join(got), "<u4")
        self.ids = _room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _home(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        h = one * np.uint64(0x9E3779B97F4A7C15) ^ two * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(65 - len(self.one).bit_length())).astype(np.int64)

    def _find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, and the places of those that got a new one, in the order of their numbers."""
        at = self._home(one, two)
        left = np.flatnonzero((self.one.take(at) != one) | (self.two.take(at) != two))
        if 2 * (self.n + len(left)) > len(self.one):
            kept = np.flatnonzero(self.two)
            self._refill(self.one[kept], self.two[kept], self.number[kept], 2 * (self.n + len(left)))
            at, left = self._home(one, two), np.arange(len(one))
        new = self._place(at, one, two, left)
        self.number[at[new]] = np.arange(self.n, self.n + len(new))
        self.n += len(new)
        return self.number.take(at), new

    def _refill(self, one: np.ndarray, two: np.ndarray, number: np.ndarray, least: int) -> None:
        self._entries(1 << int(least).bit_length())
        at = self._home(one, two)
        self._place(at, one, two, np.arange(len(one)))
        self.number[at] = number

    def _place(self, at: np.ndarray, one: np.ndarray, two: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Moves `at` on to the entries of the pieces `left`, made if there is none; returns one place of each that was made."""
        made = [left[:0]]
        while len(left):
            a = at[left]
            free = self.two.take(a) == 0
            j, f = left[free], a[free]
            self.number[f] = j  # of several at a free entry, one takes it
            won = self.number.take(f) == j
            j, f = j[won], f[won]
            self.one[f], self.two[f] = one[j], two[j]
            made.append(j)
            left = left[(self.one.take(a) != one[left]) | (self.two.take(a) != two[left])]
            at[left] = (at[left] + 1) & (len(self.one) - 1)
        return np.concatenate(made)

    def _halve(self) -> None:
        last = self.last[: self.n]
        stay = np.flatnonzero(last > np.median(last))
        to = np.full(self.n, -1, np.int32)
        to[stay] = np.arange(len(stay))
        kept = np.flatnonzero(self.two)
        kept = kept[to[self.number[kept]] >= 0]
        one, two, number = self.one[kept], self.two[kept], to[self.number[kept]]
        long = {p: int(to[k]) for p, k in self.long.items() if to[k] >= 0}
        first, size, last = self.first[stay], self.size[stay], last[stay]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        ids = self.ids[at]
        self._clear()
        self._refill(one, two, number, 2 * len(stay) + 2)
        self.n, self.long, self.ids, self.used = len(stay), long, _room(ids, 1 << 14), len(ids)
        self.first, self.size, self.last = (_room(a, 1 << 12) for a in (np.cumsum(size, dtype=np.int32) - size, size, last))
