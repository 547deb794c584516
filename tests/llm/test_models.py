"""Operators 3, 4 and 6: held-out accuracy, the base score against brute force, and awkward tables."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungline.llm import ctw, language, quality_model, queries

from ..conftest import MIDDLE
from .cases import awkward, fold, frame, lower, repeated, words


def rows_of(spark, table="documents"):
    return spark.read.parquet(f"{MIDDLE}/{table}.parquet").collect()


# ---------------------------------------------------------------- operator 3


def base_scores(rows):
    tokens = lambda t: [*words(lower(t)), None]
    c = Counter(w for i, t in rows if fold(i, 7) != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (fold(i, 7) == 2, len(tokens(t)), sum(w in c for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + (v + 1))) for w in tokens(t))) for i, t in rows}


def check_scores(rows, got):
    want = base_scores(rows)
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0


@pytest.mark.parametrize("max_words", [1 << 19, 60])
def test_base_scores_of_awkward_texts(spark, max_words):
    rows = awkward()
    check_scores([r[:2] for r in rows], ctw.score_documents(frame(spark, rows), max_words=max_words).collect())


def test_scores_of_all_documents(spark):
    got = queries.op3_context_tree_weighting(spark, MIDDLE).collect()
    check_scores([(r.doc_id, r.text) for r in rows_of(spark)], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)  # logs are negative


def test_probabilities_add_up(spark):
    """After any context the 256 bytes' probabilities add up to one."""
    rows = awkward()
    m = ctw.fit(ctw.gather(frame(spark, rows, extra=False)), 1 << 20, 1 << 10, 4).open()
    for context in (b"\n\n\n\n\n", b"word ", b" w1 \xff"):
        code = sum(b << (8 * (len(context) - k)) for k, b in enumerate(context))
        logs = m.window_logs(np.array([code | b for b in range(256)], np.uint64))
        assert (10.0**logs).sum() == pytest.approx(1.0, abs=1e-5)


def test_weights_follow_the_recursion():
    """A tiny tree by the definition: P_w = (P_kt + product of the children's) / 2."""
    key, n0, n1 = np.array([1, 257, 513]), np.array([2, 1, 1]), np.array([3, 3, 0])
    log, stop = ctw.weigh(np.array([1]), n0[:1], n1[:1], None)
    kt = lambda a, b: math.prod((k + 0.5) for k in range(a)) * math.prod((k + 0.5) for k in range(b)) / math.factorial(a + b)
    assert math.exp(log[0]) == pytest.approx(kt(2, 3)) and stop[0] == 1
    below = (np.array([(5 << 16) | (1 << 8) | 7, (5 << 16) | (2 << 8) | 7]), np.log([0.25, 0.5]))
    both, stop = ctw.weigh(np.array([(5 << 8) | 7]), np.array([2]), np.array([3]), below)
    assert math.exp(both[0]) == pytest.approx(0.5 * kt(2, 3) + 0.5 * 0.125)
    assert stop[0] == pytest.approx(0.5 * kt(2, 3) / math.exp(both[0]))


def test_scores_of_repeated_and_no_rows(spark):
    assert ctw.score_documents(frame(spark, repeated())).count() == len(repeated())
    assert ctw.score_documents(frame(spark, [])).count() == 0
    only_held = [r for r in awkward() if fold(r[0], 7) == 2]
    got = ctw.score_documents(frame(spark, only_held)).collect()
    assert len(got) == len(only_held) and all(r.train_tokens == 0 and math.isfinite(r.score) and r.n_known == 0 for r in got)


def test_scores_come_from_all_nodes(spark):
    """However little is broadcast, a score is that of all nodes in one table."""
    rows = awkward()
    train = frame(spark, [r for r in rows if fold(r[0], 7) != 2], extra=False)
    plain = ctw.fit(ctw.gather(train), 1 << 40, 1 << 10, 4).open()
    want = {}
    for i, t, *_ in rows:
        body = b"\n" * ctw.DEPTH + b"".join(w.encode() + b" " for w in words(lower(t))) + b"\n"
        codes = [int.from_bytes(body[k - ctw.DEPTH : k + 1], "big") for k in range(ctw.DEPTH, len(body))]
        want[i] = plain.window_logs(np.array(codes, np.uint64)).sum()
    for bound in (1 << 21, 200, 0):
        got = ctw.score_documents(frame(spark, rows), None, bound).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-5)


# ---------------------------------------------------------------- operator 4


def test_languages_of_held_out_documents(spark):
    lang = {r.doc_id: (r.lang, r.text) for r in rows_of(spark)}
    got = queries.op4_language_id(spark, MIDDLE).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in lang[r.doc_id][1] or ""))
    held = [r for r in got if r.held_out and lang[r.doc_id][0] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in held) > 0.97 * len(held)


def test_language_and_source_are_no_inputs(spark):
    """The same texts without lang and source get the same predictions from the same dictionaries."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("doc_id < 200")
    udf = language.predictor(language.learn(docs, F.lit(True)))
    a = docs.select(udf("text").alias("p")).select("p.*").collect()
    b = docs.select("text").select(udf("text").alias("p")).select("p.*").collect()
    assert a == b


def test_languages_of_awkward_texts(spark):
    got = language.identify(frame(spark, repeated())).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in repeated())
    learned = {"en", "de", "fr", "es"}
    texts = {}
    for i, t, *_ in repeated():
        texts.setdefault(i, []).append(t)
    for r in got:
        assert r.lang_pred in learned | {"und"}
        if not any(c.isalpha() for t in texts[r.doc_id] for c in t or ""):
            assert r.lang_pred == "und" and r.score == 0
    kept = language.keep_identified(frame(spark, repeated()))
    assert kept.columns == frame(spark, []).columns and kept.count() <= len(repeated())
    assert language.identify(frame(spark, [])).count() == 0
    nothing = [(r[0], r[1], None, None, 0) for r in awkward()]
    assert {r.lang_pred for r in language.identify(frame(spark, nothing)).collect()} == {"und"}


def test_ties_and_narrow_margins_are_rejected(spark):
    df = spark.createDataFrame([("ab cd",), ("",), (None,), ("12 34",)], "text string")
    udf = language.predictor(language.Languages({"x": b"the same words", "y": b"the same words"}))
    got = df.select(udf("text").alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [("x", 0.0, True), ("und", 0.0, True), ("und", 0.0, True), ("und", 0.0, True)]
    model = language.Languages({"x": b"some words of one language", "y": b"andere Worte einer anderen"})
    ways = language.compressors(model)
    text = " ".join(f"q{k}" for k in range(3000))
    sizes, order = language.measured(text.encode(), ways)
    share = (sizes[order[1]] - sizes[order[0]]) / sizes[order[0]]
    assert language.predicted(text, ["x", "y"], ways, share + 1e-3)[2] and language.predicted("some words", ["x", "y"], ways, 0.02)[0] == "x"


def test_a_language_of_many_like_texts_is_learned(spark):
    """Thousands of rows may share one id and one length, or one text, or all be long: every language is learned, from its whole texts."""
    rng = np.random.default_rng(2)
    prose = lambda words, n: " ".join(rng.choice(words, n))
    en, de, fr = (["the", "of", "then", "with", "thing"], ["der", "und", "nicht", "auch", "wird"], ["les", "une", "dans", "pour", "mais"])
    rows = [(4, prose(en, 30)[:90].ljust(90, "x"), "en", "web", 90) for _ in range(2000)] + [(100 + k, prose(de, 30), "de", "web", 1) for k in range(60)]
    rows += [(7, "le même texte", "es", "web", 1)] * 3000 + [(200 + k, prose(fr, 6000), "fr", "web", 1) for k in range(5)]
    model = language.learn(frame(spark, rows), F.lit(True))
    assert set(model.dictionaries) == {"en", "de", "es", "fr"} and len(model.dictionaries["fr"]) > 60_000
    assert len(model.dictionaries["es"]) == len("le même texte".encode())
    again = language.learn(frame(spark, rows[::-1]), F.lit(True))
    assert again == model


# ---------------------------------------------------------------- operator 6


def auc(scores, marks):
    order = np.argsort(scores, kind="stable")
    s, m = np.array(scores)[order], np.array(marks)[order]
    ranks = np.empty(len(s))
    at = 0
    for _, g in itertools.groupby(range(len(s)), key=lambda k: s[k]):
        g = list(g)
        ranks[g] = at + (len(g) + 1) / 2
        at += len(g)
    pos = m.sum()
    return (ranks[m == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(m) - pos))


def test_quality_of_held_out_documents(spark):
    marks = {r.doc_id: r.quality for r in rows_of(spark, "labels")}
    got = queries.op6_quality_classifier(spark, MIDDLE).collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    assert auc(*zip(*held, strict=True)) > 0.85


def test_quality_of_awkward_tables(spark):
    rows = repeated()
    labels = spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(awkward())] + [(13, None, 0), (None, 1, 0), (16, 7, 0), (19, 1, 1), (19, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality_model.classify(frame(spark, rows), marks).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        assert all(0 <= r.score <= 1 for r in got)
    assert quality_model.classify(frame(spark, []), labels).count() == 0
    assert quality_model.keep_good(frame(spark, rows), labels).columns == frame(spark, []).columns


def test_neighbours_are_exact():
    """Votes by blocks equal votes over a full sort of all similarities."""
    rng = np.random.default_rng(6)
    counts = rng.poisson(0.05, (300, quality_model.TERMS + quality_model.EXTRA)).astype(np.float32)
    labels = (rng.random(300) < 0.4).astype(np.float32)
    m = quality_model.NeighbourModel(counts, labels, 0.4)
    new = rng.poisson(0.05, (70, counts.shape[1])).astype(np.float32)
    y = m._unit(quality_model.weigh(new, m.idf) @ m.axes)
    want = []
    for v in y:
        sim = m.vectors @ v
        near = np.flatnonzero(sim >= np.sort(sim)[-m.neighbours])
        w = np.maximum(sim[near], 0) ** 8 * m.weight[near]
        want.append((w * labels[near]).sum() / w.sum())
    assert np.allclose(m.score(new, block=16), want, atol=1e-4)


def test_latent_axes_span_the_sample():
    """The truncated decomposition leaves no more of the sample than an exact one does, nearly."""
    rng = np.random.default_rng(7)
    counts = rng.poisson(0.05, (200, quality_model.TERMS + quality_model.EXTRA)).astype(np.float32)
    m = quality_model.NeighbourModel(counts, (rng.random(200) < 0.5).astype(np.float32), 0.5, rank=32)
    x = quality_model.weigh(counts, m.idf)
    exact = np.linalg.svd(x, compute_uv=False)[:32]
    assert np.square(x @ m.axes).sum() > 0.97 * np.square(exact).sum()
