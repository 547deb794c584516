"""Operator 10 against brute force, and its parts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from rungline.llm import near_dup, queries
from rungline.llm.common import mix64
from rungline.llm.components import connected_components

from ..conftest import MIDDLE
from .cases import awkward, frame, lower, repeated, words


def shingles(text):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def brute(rows):
    """{doc_id: (n_shingles, component_id)} of rows with ids; repeated ids share their component."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            by_shingle.setdefault(g, []).append(k)
    both = Counter()
    same = {}
    for k, (i, s) in enumerate(sets):
        if s:
            j = same.setdefault(s, i)
            a, b = sorted((find(i), find(j)))
            root[b] = a
    reps = {s: k for k, (_, s) in reversed(list(enumerate(sets)))}
    for at in by_shingle.values():
        at = [k for k in at if reps[sets[k][1]] == k]
        for x in range(len(at)):
            for y in range(x):
                both[at[y], at[x]] += 1
    for (x, y), n in both.items():
        (i, s), (j, t) = sets[x], sets[y]
        if 100 * n >= 85 * (len(s) + len(t) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(i, len(s), find(i)) for i, s in sets]


def test_links_of_awkward_texts(spark):
    rows = awkward()
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute([r[:2] for r in rows]))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_every_row_is_returned(spark):
    rows = repeated()
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = near_dup.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    # one row of each group of texts with shingles; all rows without shingles or id
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[31] <= 2 and ids[None] == 2 and ids[10] == 1


def test_links_of_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op10_hyperminhash_dedup(spark, MIDDLE).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_large_groups_and_chains(spark):
    """300 near copies of one text, a chain of texts of which each is like the next, and pairs at the threshold itself."""
    r = random.Random(5)
    base = [f"a{r.randrange(10**6)}" for _ in range(400)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(k % 4):
            w[r.randrange(len(w))] = f"b{r.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    chain = [f"c{k}" for k in range(300)]
    for k in range(30):
        rows.append((2000 - k, " ".join(chain[4 * k : 4 * k + 150])))
    for n in (185, 186, 184):  # shared of 200 shingles each: 170, 171, 169 of 200 + 200 - shared would differ around 85 %
        rows += [(3000 + n, " ".join(f"d{n}_{k}" for k in range(204))), (4000 + n, " ".join([f"d{n}_{k}" for k in range(n + 4)] + [f"e{n}_{k}" for k in range(200 - n)]))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=64).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute(rows))


def test_empty_table(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dup.keep_first(frame(spark, [])).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(4)
    errors = []
    for share in (0.2, 0.5, 0.85, 0.95):
        for n in (60, 500, 5000):
            for _ in range(8):
                both = int(2 * n * share / (1 + share))
                h = np.unique(mix64(rng.integers(1 << 62, size=2 * n - both).astype(np.uint64)))
                order = rng.permutation(h)
                a, b = np.sort(order[:n]), np.sort(order[n - both :])
                true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                e = near_dup.estimate(np.array([(near_dup.sketch(a) == near_dup.sketch(b)).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
                errors.append(e - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_components_of_a_path(spark):
    r = random.Random(1)
    names = list(range(400))
    r.shuffle(names)
    edges = [(names[k], names[k + 1]) for k in range(399) if k != 200]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[n] for n in names[:201]} == {min(names[:201])} and {got[n] for n in names[201:]} == {min(names[201:])}
    assert len(got) == 400
