"""Operator 13 against a plain search of every period."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rungline.llm import periodic, queries

from ..conftest import MIDDLE
from .cases import frame, repeated, words


def plain(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                found.setdefault((s, i + q - s), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def fast(texts, least=24, times=3):
    first = np.cumsum([0] + [len(t) for t in texts])
    number = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    names = np.array([number[w] for t in texts for w in t], np.int64)
    out = [[] for _ in texts]
    for s, n, q in zip(*periodic.find_runs(names, first, least, times), strict=True):
        row = int(np.searchsorted(first, s, "right")) - 1
        out[row].append((int(s - first[row]), int(n), int(q)))
    return out


@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 2), st.integers(1, 60)), max_size=6), max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_equal_the_plain_search(parts):
    """Texts of repeated blocks over few words, so that runs of many periods touch and overlap."""
    r = random.Random(len(parts))
    texts = []
    for text in parts:
        w = []
        for size, spread, n in text:
            block = [r.randrange(1 + spread) for _ in range(size * 3)]
            w += [block[k % len(block)] for k in range(n)]
        texts.append(w)
    assert fast(texts) == [plain(t) for t in texts]


@pytest.mark.parametrize("least,times", [(24, 3), (1, 2), (10, 2), (24, 4), (3, 5)])
def test_other_lengths(least, times):
    r = random.Random(least)
    texts = [[r.randrange(2) for _ in range(r.randrange(90))] for _ in range(60)]
    assert fast(texts, least, times) == [plain(t, least, times) for t in texts]


def test_structured_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    thue = [bin(k).count("1") % 2 for k in range(1024)]
    texts = [b, thue, [7] * 500, [k % 100 for k in range(299)], [k % 100 for k in range(300)], list(range(2000)), []]
    got = fast(texts)
    assert got == [plain(t) for t in texts]
    assert got[2] == [(0, 500, 1)] and got[3] == [] and got[4] == [(0, 300, 100)] and len(got[0]) > 20


def test_a_very_long_run_takes_seconds():
    t = time.time()
    n = 400_000
    assert fast([[1] * n]) == [[(0, n, 1)]]
    assert fast([[k % 70_000 for k in range(n)]]) == [[(0, n, 70_000)]]
    assert time.time() - t < 60


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whole(doc_id, text, plant=True):
    w = words(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if plant and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def key(row):
    return tuple((v is None, v) for v in row)


def test_query_over_awkward_rows(spark, tmp_path):
    rows = repeated() + [(5000 + k, "a b c " * (k + 1) + f"x{k} y " * k, "en", None, 1) for k in range(90)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    short = [(i, t) for i, t, *_ in rows]
    got = sorted([tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()], key=key)
    assert got == sorted([whole(i, t) for i, t in short], key=key)
    assert sum(r[1] > 0 for r in got) > 60


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 15_000}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, MIDDLE).collect()}
    assert len(got) == len(docs) and len(short) > 900
    assert all(got[i] == whole(i, t) for i, t in short.items())


def test_the_operator_gives_texts(spark):
    rows = [(1, "a  b\n" + "c d " * 30 + "e", "en", None, 1), (2, None, None, None, None)]
    got = {r.doc_id: r for r in periodic.periodic_runs(frame(spark, rows)).collect()}
    assert [tuple(x) for x in got[1].runs] == [(2, 60, 2)] and got[1].collapsed == "a b c d e" and got[1].n_words == 63
    assert got[2].runs == [] and got[2].collapsed == "" and got[2].n_words == 0


def test_an_empty_table(spark):
    assert periodic.periodic_runs(frame(spark, [])).count() == 0
