"""Operator 7, byte-level BPE by speculation and verification, and its decoding.

Texts are cut at single spaces into chunks, and each new chunk into pieces; for each a greedy longest match proposes tokens. A proposal is BPE's own result exactly when every adjacent pair
of its tokens stays two tokens when encoded alone; that is tested for all pairs at once on arrays, by undoing merges. Only pieces with a
failing pair are merged exactly, rank by rank. Null text counts as empty: no ids, and the digests of empty strings. Rows with null or
repeated doc_id are encoded like any other; an empty table gives no rows; a very long text is encoded whole, by itself."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_model
from .pieces import _BYTE_LEVEL, cuts, numbered, ordinary, runs, spaced

#: Fixed value: the splitting pattern for any text, with Unicode's white space spelled out.
_WS = r"\t-\r \x85\xa0  -     　"
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_INF = np.int64(1) << 40


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class SpeculativeBPE:
    def __init__(self, path: str, keep: int = 128 << 20):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = _byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes = [b""] * size
        for t, i in vocab.items():
            if all(c in back for c in t):
                self.bytes[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        # order[i]: a token's place in merge order; bytes come before all merges
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        n_bytes = 256
        self.order = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for b, c in enumerate(letters):
            self.order[vocab[c]] = b
        for k, (a, b) in enumerate(merges):
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            self.rank.setdefault((x, y), (k, i))
            if self.order[i] < 0:
                self.order[i], self.left[i], self.right[i] = n_bytes + k, x, y
        pair = np.array([[x, y, k, i] for (x, y), (k, i) in self.rank.items()], np.int64).reshape(-1, 4)
        key = pair[:, 0] * size + pair[:, 1]
        by = np.argsort(key)
        self.pair_key, self.pair_order, self.pair_new, self.size = key[by], pair[by, 2] + n_bytes, pair[by, 3], size
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.match = ahocorasick.Automaton()
        for t, i in vocab.items():
            if self.order[i] >= 0:
                self.match.add_word(t, i)
        self.match.make_automaton()
        self.to_letters = {b: c for b, c in enumerate(letters)}
        #: for each known piece its number of ids, the ids as text, and their bytes: about `keep` bytes; as much at most of chunks
        self.keep, self.held, self.known_pieces = keep, 0, {}
        self.held_chunks, self.known = 0, {"": (0, "", b"")}
        self.once = bytearray(1 << 22)  # by hash: was a chunk new before? A chunk that comes but once isn't kept
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.speculated = self.failed = 0

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does BPE leave a followed by b as these two tokens?

        Undo merges from the later of the two inner tokens at the seam. If two tokens that meet at the seam could merge before the
        merge that hides the seam, the pair isn't stable."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y, limit = a.copy(), b.copy(), np.full(len(a), _INF)
        while len(live):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            clash = (self.pair_key[at] == key) & (self.pair_order[at] < limit)
            ok[live[clash]] = False
            ox, oy = self.order[x], self.order[y]
            # split the one that was merged later; a byte can't be split
            is_x = ox > oy
            can = np.where(is_x, self.right[x], self.left[y]) >= 0
            stop = clash | ~can
            limit = np.where(is_x, ox, oy + 1)
            x, y = np.where(is_x & can, self.right[x], x), np.where(~is_x & can, self.left[y], y)
            go = ~stop
            live, x, y, limit = live[go], x[go], y[go], limit[go]
        return ok

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words: in each round every word merges its pair of lowest rank wherever it stands, from the left."""
        size = np.array([len(w) for w in words], np.int64)
        ids, word = self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            key = np.append(ids[:-1] * self.size + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            new = np.append(word[1:] != word[:-1], True)  # the last token of a word has no pair
            order = np.where((self.pair_key[at] == key) & ~new, self.pair_order[at], _INF)
            start = np.concatenate([[0], np.flatnonzero(new)[:-1] + 1])
            low = np.minimum.reduceat(order, start)
            count = np.diff(np.append(start, len(ids)))
            open_ = np.repeat(low < _INF, count)
            done.append((word[~open_], ids[~open_]))
            # of pairs that overlap (in runs of one token) every other one
            hit = np.flatnonzero(open_ & (order == np.repeat(low, count)))
            first = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))) % 2 == 0]
            ids[hit] = self.pair_new[at[hit]]
            open_[hit + 1] = False
            ids, word = ids[open_], word[open_]
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        by = np.argsort(word, kind="stable")
        cut, flat = np.searchsorted(word[by], np.arange(len(words) + 1)).tolist(), ids[by].tolist()
        return [flat[a:z] for a, z in zip(cut, cut[1:], strict=False)]

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        raw = [t.encode() for t in texts]
        joined = "\n".join(r.decode("latin-1").translate(self.to_letters) for r in raw)  # \n is no byte letter
        ends = np.cumsum([len(r) + 1 for r in raw]) - 1
        if not raw:
            return []
        found = list(self.match.iter_long(joined))
        end, ids = np.array([e for e, _ in found], np.int64), np.array([i for _, i in found], np.int64)
        owner = np.searchsorted(ends, end, "right")
        pairs = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.zeros(len(texts), bool)
        if len(pairs):
            keys, where = np.unique(ids[pairs] * self.size + ids[pairs + 1], return_inverse=True)
            ok = self.compatible(keys // self.size, keys % self.size)[where]
            bad[owner[pairs[~ok]]] = True
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        flat = ids.tolist()
        # a proposal must also cover its piece
        covered = np.bincount(owner, weights=self.length[ids], minlength=len(texts)) if len(ids) else np.zeros(len(texts))
        bad |= covered != [len(r) for r in raw]
        self.speculated, self.failed = self.speculated + len(texts), self.failed + int(bad.sum())
        cut = first.tolist()
        out = [flat[a:z] for a, z in zip(cut, cut[1:], strict=False)]
        wrong = np.flatnonzero(bad).tolist()
        for k, made in zip(wrong, self.merge([raw[k] for k in wrong]), strict=True):
            out[k] = made
        return out

    def split(self, text: str) -> list[str]:
        fast = ordinary(text)
        out: list[str] = []
        for part in cuts(text):
            out += (_BYTE_LEVEL if fast else _ANY).findall(part)
        return out

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; the text of a special token stands as itself."""
        if any(s in text for s in self.special):
            out: list[str] = []
            for k, part in enumerate(regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text)):
                out += [part] if k % 2 else self.split(part)
            return out
        return self.split(text)

    def encode_chunks(self, chunks: list[str], split=_BYTE_LEVEL.findall) -> list[tuple[int, str, bytes]]:
        """For each distinct chunk (by default of an ordinary text): how many ids, the ids as text, their bytes. New chunks are encoded together."""
        got = list(map(self.known.get, chunks))
        new = [c for c, g in zip(chunks, got, strict=True) if g is None]
        if not new:
            return got
        if self.held_chunks > self.keep // 2:  # what these texts use stays: that holds the frequent chunks
            self.known = {"": (0, "", b"")} | {c: g for c, g in zip(chunks, got, strict=True) if g is not None}
            self.held_chunks, self.once = sum(map(self._size, self.known.values())), bytearray(len(self.once))
        split = [split(c) for c in new]
        if self.held > self.keep:
            self.known_pieces, self.held = {}, 0
        known = self.known_pieces
        for s, i in self.special.items():
            known[s] = 1, str(i), self.bytes[i]
        todo = [p for p in set().union(*split) if p not in known]
        for at in range(0, len(todo), 20_000):
            for p, ids in zip(todo[at : at + 20_000], self.encode_pieces(todo[at : at + 20_000]), strict=True):
                known[p] = made = len(ids), ",".join(map(str, ids)), b"".join([self.bytes[i] for i in ids])
                self.held += self._size(made)
        fresh, top = [], len(self.once) - 1
        for c, s in zip(new, split, strict=True):
            if len(s) == 1:
                made = known[s[0]]
            else:
                n, said, raw = zip(*[known[p] for p in s], strict=True)
                made = sum(n), ",".join(said), b"".join(raw)
            fresh.append(made)
            h = hash(c) & top
            if self.once[h]:
                self.known[c] = made
                self.held_chunks += self._size(made)
            else:
                self.once[h] = 1
        fresh = iter(fresh)
        return [next(fresh) if g is None else g for g in got]

    @staticmethod
    def _size(made: tuple) -> int:
        return 250 + len(made[1]) + 2 * len(made[2])

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[bytes]]:
        """For each text: how many ids, the ids as text joined by commas, and their bytes."""
        ready, whole = [], {}
        for k, t in enumerate(texts):
            if t and (not ordinary(t) or any(s in t for s in self.special)):
                whole[k] = self._whole(t)
                t = ""
            ready.append(spaced(t) if t else "")
        chunks, code, stop = numbered(ready)
        made = self.encode_chunks(chunks)
        n, said, raw = zip(*made, strict=True) if made else ((), (), ())
        # a chunk without ids (an empty text) adds no comma
        offsets = pa.array(np.concatenate([[0], stop]), pa.int32())
        joined = lambda values, sep: pc.binary_join(pa.ListArray.from_arrays(offsets, values.take(pa.array(code))), pa.scalar(sep, values.type))
        ids, plain = joined(pa.array(said, pa.large_string()), ","), joined(pa.array(raw, pa.large_binary()), b"")
        counts = np.concatenate([[0], np.cumsum(np.asarray(n, np.int64)[code])])[np.concatenate([[0], stop])]
        counts, ids, plain = np.diff(counts), ids.to_pylist(), plain.to_pylist()
        for k, (x, y, z) in whole.items():
            counts[k], ids[k], plain[k] = x, y, z
        return counts, ids, plain

    def _whole(self, text: str) -> tuple[int, str, bytes]:
        """A text that isn't cut at spaces: its pieces are the chunks."""
        made = dict(zip(found := list(dict.fromkeys(split := self.pieces(text))), self.encode_chunks(found, lambda p: [p]), strict=True))
        return sum(made[p][0] for p in split), ",".join([made[p][1] for p in split]), b"".join([made[p][2] for p in split])

    def encode(self, text: str) -> list[int]:
        said = self.encode_many([text])[1][0]
        return [int(i) for i in said.split(",")] if said else []

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", errors="replace")


def model(path: str) -> SpeculativeBPE:
    """One for each worker process and vocabulary file."""
    return worker_model(("bpe", path), lambda: SpeculativeBPE(path))


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document. Decoding goes from the ids through the token table."""

    def run(batches):
        bpe = model(path)
        for b in batches:
            texts, n, ids, plain = [t or "" for t in b.column(1).to_pylist()], [], [], []
            for a, z in runs(texts):
                count, said, raw = bpe.encode_many(texts[a:z])
                n.append(count)
                ids += [hashlib.sha256(x.encode()).hexdigest() for x in said]
                plain += [hashlib.sha256(x.decode("utf-8", errors="replace").encode()).hexdigest() for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n or [np.zeros(0, np.int64)])), pa.array(ids, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
