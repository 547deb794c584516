"""Whole-text encoding with the tokenizers library, which sees each distinct chunk of text about once.

Both public vocabularies split a text by a pattern and encode each piece by itself. For the byte-level one, texts are cut at white space
into chunks, Arrow numbers the distinct ones, and ids that are known are looked up by number; for the word-level one, word_pieces finds
pieces and their ids. Texts outside Latin-1, with characters whose class differs between pattern engines, or with the text of a special
token go through the library whole, as does every text of a tokenizer whose splitting is not one of the two known ones."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_model
from .word_pieces import WordTable, dealt

#: The byte-level splitting pattern, for Latin-1 texts without the characters in _ODD.
_BYTE_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0\xaa\xb2\xb3\xb5\xb9\xba\xbc\xbd\xbe"
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")
_LONG = 1 << 20
_SEP = "\x1c"  # in no ordinary text


def cuts(text: str, limit: int = _LONG):
    """Pieces of a very long text, cut at single spaces between other characters, where every known splitting also cuts."""
    at = 0
    while len(text) - at > limit:
        m = _CUT.search(text, at + limit)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def ordinary(text: str) -> bool:
    """Latin-1 without the characters in _ODD, so that all pattern engines split it alike."""
    if text.isascii():
        return not any(c in text for c in _ODD[:4])
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in _ODD)


def _pairs(text: str) -> bool:
    """Is there a space before other white space, or at an end of the text?"""
    return "  " in text or " \n" in text or text[0] == " " or text[-1] == " " or any(c in text and " " + c in text for c in "\t\r\x0b\x0c")


def spaced(text: str) -> str:
    """An ordinary text with a mark before each single space: what stands between marks is split the same way by itself."""
    return _SEP.join([p for part in cuts(text, 1 << 12) for p in _BYTE_LEVEL.findall(part)]) if _pairs(text) else text.replace(" ", _SEP + " ")


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks of texts cut at marks, each text's chunks by number, and where each text's end."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), _SEP)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)


class PieceEncoder:
    """ids(text): the little-endian unsigned 32-bit ids, as bytes. Known chunks take about `keep` bytes, and what a call adds to them; then those stay that the call met."""

    def __init__(self, path: str, keep: int = 160 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        self.special = [a["content"] for a in spec["added_tokens"]]
        pre, norm = spec["pre_tokenizer"] or {}, json.dumps(spec["normalizer"])
        self.known_split, self.lower = False, False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm == "null":
            self.known_split = True
        elif [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and "[\\p{N}]|" in pre["pretokenizers"][0]["pattern"].get("Regex", "") and "Lowercase" in norm:
            self.known_split, self.lower = True, True
        # pieces are lower case with single spaces between, and Latin-1 letters are composed: they need neither normalizer nor pattern any more
        split = self.lower and {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, pre["pretokenizers"][1]]}
        self.ready = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": split})) if self.lower else self.tok
        # ids that close a piece of the word-level vocabulary, or open one with a space of the byte-level vocabulary
        vocab = self.tok.get_vocab()
        self.edge = np.zeros(1 + max(vocab.values()), bool)
        suffix = spec["model"].get("end_of_word_suffix")
        self.edge[[i for t, i in vocab.items() if (t.endswith(suffix) if self.lower and suffix else t.startswith("\u0120"))]] = True
        self.keep, self.held = keep, 0
        self.known: dict[str, bytes] = {"": b""}
        self.marks = {c: self.whole(c) for c in ".,;:!?"}
        self.words = WordTable(lambda new: self._learn(new), keep) if self.lower else None

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bool:
        return self.known_split and not any(s in text for s in self.special) and ordinary(text)

    def ids(self, text: str | None) -> bytes:
        return self.ids_many([text])[0]

    def ids_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; chunks that are new in any of them are encoded together."""
        whole = {k: self.whole(t) for k, t in enumerate(texts) if t and not self.plain(t)}
        ready = ["" if k in whole else t or "" for k, t in enumerate(texts)]
        if self.words:
            out = []
            for a, z in runs(ready, _LONG):  # short runs stay in the processor's cache
                out += self.words.texts(ready[a:z]) if z > a + 1 else [b"".join([self.words.texts([p])[0] for p in cuts(ready[a])])]
        else:
            chunks, code, stop = numbered([spaced(t) if t else "" for t in ready])
            got = self._look(chunks)
            size = np.fromiter(map(len, got), np.int32, len(got)) >> 2
            out = dealt(np.frombuffer(b"".join(got), "<u4"), np.cumsum(size, dtype=np.int32) - size, size, code, stop)
        return [whole.get(k, x) for k, x in enumerate(out)]

    @staticmethod
    def _size(chunks) -> int:
        """About how many bytes chunks and their ids take."""
        return 170 * len(chunks) + 3 * sum(map(len, chunks))

    def _look(self, chunks: list[str]) -> list[bytes]:
        got = list(map(self.known.get, chunks))
        new = [c for c, g in zip(chunks, got, strict=True) if g is None]
        if new:
            if self.held > self.keep:  # what these texts use stays: that holds the frequent chunks
                self.known = {"": b""} | {c: g for c, g in zip(chunks, got, strict=True) if g is not None}
                self.held = self._size(self.known)
            fresh = iter(self._learn(new))
            got = [next(fresh) if g is None else g for g in got]
        return got

    def _learn(self, new: list[str]) -> list[bytes]:
        """The ids of new chunks, which become known."""
        known, marks = self.known, self.marks
        if self.words:
            base, joint, rest = {}, new, []
        else:
            # a word and a mark: letters and marks are never in one piece
            words = [c[:-1] if c[-1] in marks and c[-2:-1].isalpha() else c for c in new]
            base = dict.fromkeys([w for w in words if w not in known])
            # together: chunks that begin with their only space
            joint = [c for c in base if c[0] == " " and len(c) > 1 and not c[1].isspace()]
            rest = [c for c in base if not (c[0] == " " and len(c) > 1 and not c[1].isspace())]
        for at in range(0, len(joint), 20_000):
            rest += self._encode(joint[at : at + 20_000], base)
        for at in range(0, len(rest), 20_000):
            for c, e in zip(rest[at : at + 20_000], self.tok.encode_batch_fast(rest[at : at + 20_000], add_special_tokens=False), strict=True):
                base[c] = array("I", e.ids).tobytes()
        if self.words:
            return [base[c] for c in new]
        out = [base[w] if w in base else known[w] for w in words]
        out = [ids if len(w) == len(c) else ids + marks[c[-1]] for c, w, ids in zip(new, words, out, strict=True)]
        known.update(zip(new, out, strict=True))
        self.held += self._size(new)
        return out

    def _encode(self, chunks: list[str], out: dict[str, bytes]) -> list[str]:
        """Encode chunks together, into `out`; returns them if the ids don't show where each one ends."""
        glue, run = (" ", 100) if self.lower else ("", 500)
        texts = [glue.join(chunks[k : k + run]) for k in range(0, len(chunks), run)]  # short texts stay in the processor's cache
        ids = np.array([i for e in self.ready.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], "<u4")
        mark = np.flatnonzero(self.edge[ids])
        if len(mark) != len(chunks) or (mark[-1] != len(ids) - 1 if self.lower else mark[0] != 0):
            return chunks
        stop = (mark + 1 if self.lower else np.append(mark[1:], len(ids))) * 4
        raw, a = ids.tobytes(), 0
        for c, z in zip(chunks, stop.tolist(), strict=True):
            out[c] = raw[a:z]
            a = z
        return []


def runs(texts: list[str | None], limit: int = 1 << 22):
    """Ranges of texts with about `limit` characters; a longer text stands alone."""
    a, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > a and size + n > limit:
            yield a, k
            a, size = k, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def encoder(path: str) -> PieceEncoder:
    """One for each worker process and vocabulary file."""
    return worker_model(("pieces", path), lambda: PieceEncoder(path))
