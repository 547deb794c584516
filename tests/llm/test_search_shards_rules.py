"""Operators 5, 8 and 9 against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rungline.llm import quality_rules, queries, sharding, topk

from ..conftest import MIDDLE
from .cases import awkward, frame, repeated, words


# ---------------------------------------------------------------- operator 5


def best(rows, every, k):
    sound = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in dict.fromkeys((i, tuple(v)) for i, v in sound if i is not None and i % every == 0):
        others = list(sound)
        others.remove((q, list(v)))
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), -(1 << 63) if i is None else i) for i, w in others)
        out += [(q, r + 1, None if i == -(1 << 63) else i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return df.withColumns({"shard": F.lit("x"), "block": F.lit(1), "times": F.lit(2), "v": F.lit("y"), "score": F.lit(0.5), "rank": F.lit(3)})


@pytest.mark.parametrize("shard_rows,query_rows", [(8192, 512), (40, 2)])
def test_top_k_of_awkward_vectors(spark, shard_rows, query_rows):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=9)]) for k in range(300)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 7), (302, [math.nan] * 9), (303, [math.inf] + [0.0] * 8), (304, [0.0] * 9), (350, [-1.0] * 9), (None, [2.0] * 9), (306, rows[7][1]), (307, rows[7][1])]
    got = topk.top_k(vectors(spark, rows), every=50, k=5, shard_rows=shard_rows, query_rows=query_rows)
    assert sorted(map(tuple, got.collect()), key=str) == best(rows, 50, 5)


def test_top_k_with_few_rows(spark):
    assert topk.top_k(vectors(spark, [(0, [1.0]), (1, [2.0])])).collect()[0][:] == (0, 1, 1, 256 * 512)
    assert topk.top_k(vectors(spark, [(0, [1.0])])).count() == 0
    assert topk.top_k(vectors(spark, [])).count() == 0


def test_top_k_of_all_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op5_max_score(spark, MIDDLE).collect()), key=str) == best(rows, 50, 5)


# ---------------------------------------------------------------- operator 8


def counted(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    places, found = {}, set()
    for k in range(len(w) - 2):
        places.setdefault(tuple(w[k : k + 3]), []).append(k)
    for at in places.values():
        if len(at) > 1:
            found |= {a + j for a in at for j in range(3)}
    n, rep = len(w), len(found)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")


def test_base_rules_of_awkward_texts(spark):
    rows = repeated()
    got = quality_rules.quality_rules(frame(spark, rows), labels_of(spark, rows)).collect()
    assert Counter(tuple(r[c] for c in BASE) for r in got) == Counter((r[0], *counted(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_base_rules_of_all_documents(spark):
    got = queries.op8_quality_rules(spark, MIDDLE).collect()
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r[c] for c in BASE) for r in got) == Counter((r.doc_id, *counted(r.text)) for r in rows)


def test_rules_need_no_rows(spark):
    assert quality_rules.quality_rules(frame(spark, []), labels_of(spark, [])).count() == 0
    rows = awkward()
    got = quality_rules.quality_rules(frame(spark, rows), labels_of(spark, [])).collect()
    assert all(r.kept == (not r.base_failed) for r in got)


@pytest.mark.parametrize("n,p,error", [(10, 0.02, 0.05), (300, 0.02, 1e-3), (2000, 0.02, 1e-5), (1, 0.5, 0.6)])
def test_binomial_bound_is_exact(n, p, error):
    q = Fraction(p)
    tail, most = Fraction(0), -1
    for k in range(n + 1):
        tail += math.comb(n, k) * q**k * (1 - q) ** (n - k)
        if tail > Fraction(error):
            break
        most = k
    assert quality_rules.most_allowed(n, p, error) == min(most, int(n * p))


def first_rejected(values, path):
    """The first step at which any rule rejects a document."""
    return next((k for k in range(quality_rules.STEPS) if any(values[r] > path[r][k] for r in quality_rules.RULES)), quality_rules.STEPS)


def test_verdicts_equal_brute_force(spark):
    """Paths, the fixed sequence and the verdict over again in plain Python, on one table with two strata, small and large."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        lang = "en" if i < 2600 else ("de" if i < 2960 else None)
        n = 60 + int(rng.integers(60))
        w = [f"w{int(x)}" for x in rng.integers(0, 100_000, n)]
        for j in range(int(rng.integers(3)) + (20 if i % 9 == 0 else 0)):
            w[j] += "#"
        rows.append((i, " ".join(w), lang, "web", 0))
    labels = spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    measured = quality_rules._shares(quality_rules.measures(docs, ["doc_id", "lang"]))
    good = {r.doc_id: r for r in measured.collect() if not r.base_failed}
    half = lambda i: zlib.crc32(f"{i}|half".encode()) % 2
    path = {r["__s"]: {x: r[f"path_{x}"] for x in quality_rules.RULES} for r in quality_rules.paths(measured.where(F.col("doc_id").isin([i for i in good if i % 9 and half(i) == 0])), "lang").collect()}
    cuts, strata = {}, {r.lang for i, r in good.items() if i % 9 and half(i) == 1}
    for s in strata:
        held = [first_rejected(r, path[s]) for i, r in good.items() if r.lang == s and i % 9 and half(i) == 1]
        most = quality_rules.most_allowed(len(held), 0.02, 0.05 / len(strata))
        sure = [k for k in range(quality_rules.STEPS) if all(sum(h <= j for h in held) <= most for j in range(k + 1))]
        cuts[s] = sure[-1] if sure else None
    assert cuts["en"] is not None and cuts[None] is None
    want = {i: not any(cuts[r.lang] is not None and r[x] > path[r.lang][x][cuts[r.lang]] for x in quality_rules.RULES) for i, r in good.items()}
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()}
    assert got == want | {i: False for i in range(3000) if i not in good}
    assert sum(not got[i] for i in range(2600) if i % 9 == 0) > 250 and sum(not got[i] for i in range(2600) if i % 9) < 0.02 * 2400


def test_three_hundred_good_documents_certify_a_setting(spark):
    values = [f"id / 1e6 AS {r}" for r in quality_rules.RULES]
    measured = spark.range(600).selectExpr("id AS doc_id", "'es' AS lang", "false AS base_failed", *values)
    labels = spark.range(600).selectExpr("id AS doc_id", "1 AS quality")
    assert quality_rules.cutoffs(measured, labels, "lang", 0.02, 0.05).count() == 1
    assert quality_rules.cutoffs(measured.where("id < 100"), labels, "lang", 0.02, 0.05).count() == 0
    with pytest.raises(ValueError):
        quality_rules.cutoffs(measured.withColumn("lang", F.col("doc_id").cast("string")), labels, "lang", 0.02, 0.05, most_strata=100)


def test_good_documents_stay(spark):
    rows = {r.doc_id: r for r in queries.op8_quality_rules(spark, MIDDLE).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    good = [r.doc_id for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").where("quality = 1").collect()]
    good = [i for i in good if not rows[i].base_failed]
    for x in set(lang.values()):
        own = [i for i in good if lang[i] == x]
        assert sum(not rows[i].kept for i in own) <= 0.02 * len(own)


# ---------------------------------------------------------------- operator 9


def test_shards(spark):
    rows = repeated()
    got = sharding.shard_documents(frame(spark, rows)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    assert all(r.law == "key" and 0 <= r["shard"] < 8 and r.grown_shard in (r["shard"], 8) for r in got)
    for s in range(8):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, (r["shard"], r.grown_shard)) == (r["shard"], r.grown_shard)


def test_shards_of_all_documents(spark):
    got = queries.op9_hash_tree_sharding(spark, MIDDLE).collect()
    n = Counter(r["shard"] for r in got)
    assert sum(n.values()) == 1000 and all(70 <= n[k] <= 190 for k in range(8))
    assert 60 <= sum(r.grown_shard == 8 for r in got) <= 170


def test_weights_are_followed(spark):
    tree = [sharding.Shard(0, 0, 0, 1), sharding.Shard(0, 1, 1, 3), sharding.Shard(1, 2, 2, 4)]
    heavier = [sharding.Shard(0, 0, 0, 1), sharding.Shard(0, 1, 1, 7), sharding.Shard(1, 2, 2, 4)]
    df = spark.range(8000).selectExpr("cast(id AS string) AS __key")
    got = sharding.descend(sharding.descend(df, tree, "a"), heavier, "b").collect()
    n = Counter(r.a for r in got)
    assert abs(n[0] - 1000) < 200 and abs(n[1] - 3000) < 250 and abs(n[2] - 4000) < 250
    # rows move only into the region that grew and, within it, only into the rack that grew
    assert {(r.a, r.b) for r in got if r.a != r.b} == {(2, 0), (2, 1), (0, 1)}


def test_shards_of_an_empty_table(spark):
    assert sharding.shard_documents(frame(spark, [])).count() == 0


@given(st.lists(st.tuples(st.integers(0, 40), st.lists(st.integers(-300, 300), min_size=3, max_size=3)), min_size=2, max_size=40))
@settings(max_examples=80, deadline=None)
def test_a_shard_finds_the_best(rows):
    times = Counter((i, tuple(v)) for i, v in rows)
    ids, v = np.array([i for i, _ in times]), np.array([v for _, v in times])
    shard = topk.Shard(ids, np.array(list(times.values())), v)
    want = sorted((-int(np.dot(rows[0][1], w)), i) for i, w in rows[1:])[:5]
    got = shard.search(np.array(rows[0][1]), rows[0][0], 5, seeds=4)
    assert [(-s, i) for s, i in got] == want
    # a floor that the best reach changes nothing for those that reach it
    floor = -want[-1][0]
    got = shard.search(np.array(rows[0][1]), rows[0][0], 5, floor, seeds=4)
    assert [(-s, i) for s, i in got] == want


def test_terms_are_skipped():
    """Vectors near the query leave most products of the rest undone, and the best are the same."""
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(5000, 64)) * 100 / (1 + np.arange(64))).astype(int)
    q = v[0] * 3
    v[1:40] = np.floor(q / 3 + rng.normal(size=(39, 64))).astype(int)
    shard = topk.Shard(np.arange(5000), np.ones(5000, int), v)
    got = shard.search(q, 0, 5)
    assert got == sorted(((int(s), i) for i, s in enumerate(v @ q) if i), key=lambda x: (-x[0], x[1]))[:5]
    assert shard.products < 0.5 * v.size
