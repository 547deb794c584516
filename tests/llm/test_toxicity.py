"""Operator 12: layers, thresholds and word buckets against plain versions, held-out accuracy, and awkward tables."""

from __future__ import annotations

import copy
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rungline.llm import common, queries, toxicity

from ..conftest import MIDDLE
from .cases import fold, frame, repeated, words

LARGE = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def codes_of(texts):
    (_, block, off), *rest = common.slices(pa.array(texts, pa.string()))
    assert not rest
    return toxicity.word_codes(block, off)


def sample(n=200, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = [f"w{r.randrange(300)}" for _ in range(r.randrange(1, 40))]
        if k % 2:
            w.insert(r.randrange(len(w)), r.choice(["scorn", "sneer,", "Jeer"]))
        out.append(toxicity.Text(k % 2, "en" if k % 3 else "de", codes_of([" ".join(w)])[0]))
    return out


def plain_logit(net, codes):
    """Each filter over each window of one text, word by word."""
    x = [sum((net.vectors[net.tables[k][c]] for k, c in enumerate(row) if c >= 0), np.zeros(toxicity.DIMS)) for row in codes]
    pooled = []
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            values = [sum(float(x[i + j] @ net.filters[k][j][:, f]) for j in range(w) if i + j < len(x)) for i in range(len(x))]
            pooled.append(max(0.0, max(values) + float(net.bias[k * toxicity.FILTERS + f])) if values else 0.0)
    return sum(p * float(o) for p, o in zip(pooled, net.out, strict=True)) + float(net.constant[0])


def test_layers_equal_a_plain_version():
    net = toxicity.Convolution(sample(), epochs=2)
    texts = [t.codes for t in sample(30, seed=2)] + [np.zeros((0, toxicity.KINDS), np.int32)]
    texts.insert(7, texts[-1])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [plain_logit(net, t) for t in texts]
    for size in (1 << 16, 64, 5, 3, 1):  # texts are cut anywhere
        assert net.logits(np.concatenate(texts), first, size) == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_word_buckets():
    text = 'Idiot idiot### "IDIOT!" ??? idiots naïve (naïve) a  É é\n'
    codes, first = codes_of([text, None, "", "x"])
    c = [tuple(r) for r in codes[: len(words(text))]]
    assert c[0] == c[1] == c[2] and c[4][1:3] != (-1, -1) and c[4][1] == c[0][1] and c[0][2:] == (-1, -1, -1) and c[0][0] != c[4][0]
    assert c[5] == c[6] and c[3] != c[7] and c[8] != c[9] and first.tolist() == [0, 10, 10, 10, 11]


@pytest.mark.parametrize("share", [0.05, 0.5])
def test_threshold_is_the_best(share):
    rng = np.random.default_rng(3)
    y = (np.arange(200) % 3 == 0).astype(int)
    z = np.round(rng.normal(size=200) + 1.5 * y, 1)
    hit = lambda t: (z[y == 1] > t).mean() * share
    false = lambda t: (z[y == 0] > t).mean() * (1 - share)
    f1 = lambda t: 2 * hit(t) / (share + hit(t) + false(t))
    got = toxicity.threshold(z, y, share)
    assert f1(got) == pytest.approx(max(f1(t - 0.05) for t in np.unique(z)))


def rates(rows, labels):
    hit = [rows[i].predicted for i, y in labels if y == 1]
    false = [rows[i].predicted for i, y in labels if y == 0]
    return sum(hit) / len(hit), sum(false) / len(false)


@pytest.mark.parametrize("sf,least", [(MIDDLE, 0.6), (LARGE, 0.85)])
def test_held_out_accuracy(spark, sf, least):
    rows = {r.doc_id: r for r in queries.op12_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(rows) == sorted(r.doc_id for r in docs)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    hit, false = rates(rows, [x for x in labels if fold(x[0], 5) == 0])
    assert hit >= least and false <= 0.02


def test_planted_words_in_any_place(spark):
    """Texts are toxic by one word, in another language each; the model finds it after 50,000 other words, and leaves clean texts alone."""
    r = random.Random(5)
    bad = {"en": ["scorn", "sneer"], "xx": ["grelk", "grelkto", "grelkmu"]}
    rows = []
    for k in range(900):
        lang = "en" if k % 2 else "xx"
        w = [f"{lang}{r.randrange(500)}" for _ in range(60)]
        if k % 3 == 0:
            w[r.randrange(60)] = r.choice(bad[lang])
        rows.append((k, " ".join(w), lang, "web", 1))
    filler = " ".join(f"en{r.randrange(500)}" for _ in range(50_000))
    rows += [(5000, filler + " Scorn!", "xx", "web", 1), (5001, filler, "xx", "web", 1), (5002, "grelkmu " + filler, None, None, None)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(900)], LABELS)
    got = {x.doc_id: x for x in toxicity.classify(frame(spark, rows), labels).collect()}
    held = [(k, int(k % 3 == 0)) for k in range(900) if fold(k, 5) == 0]
    assert rates(got, held) == (1.0, 0.0)
    assert [got[5000 + k].predicted for k in range(3)] == [1, 0, 1]


def test_awkward_rows_are_scored_alike(spark):
    rows = repeated()
    labels = spark.createDataFrame([(r[0], 1, int(k % 4 == 0)) for k, r in enumerate(rows)] + [(10, 1, 7), (None, 1, 1), (13, 1, None)], LABELS)
    got = toxicity.classify(frame(spark, rows), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((r[0] is None, r[0]) for r in rows)
    by = {}
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, set()).add(t or "")
    for r in got:
        assert 0 <= r.score <= 1
        if len(text[r.doc_id]) == 1:
            assert by.setdefault(next(iter(text[r.doc_id])), r.score) == pytest.approx(r.score, rel=1e-4)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    rows = repeated()
    assert {r.score for r in toxicity.classify(frame(spark, rows), none).collect()} == {0.0}
    one = spark.createDataFrame([(r[0], 1, 1) for r in rows], LABELS)
    assert {r.score for r in toxicity.classify(frame(spark, rows), one).collect()} == {1.0}
    assert toxicity.classify(frame(spark, []), one).count() == 0


def test_words_of_any_learned_row_are_known(spark):
    """2400 toxic rows are learned from; a word that only the 300 with the greatest hashes have marks label 1 as well as any other."""
    r = random.Random(7)
    draws = {x.id: x.d for x in spark.range(6000).select("id", F.xxhash64(F.lit(12), F.col("id")).alias("d")).collect()}
    late = set(sorted((k for k in draws if k % 2 and fold(k, 5)), key=draws.get)[-300:])
    rows = []
    for k in range(6000):
        w = [f"w{r.randrange(300)}" for _ in range(8)]
        if k % 2:
            w[r.randrange(8)] = "grelk" if k in late or (k % 4 == 1 and not fold(k, 5)) else "scorn"
        rows.append((k, " ".join(w), "en", "web", 1))
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(6000)], LABELS)
    got = {x.doc_id: x for x in toxicity.classify(frame(spark, rows), labels).collect()}
    assert rates(got, [(k, k % 2) for k in range(6000) if not fold(k, 5)]) == (1.0, 0.0)


def marked(spark):
    """Rows of two languages, and a third's text of over 64 KiB."""
    r = random.Random(9)
    rows = [(k, " ".join([f"w{r.randrange(80)}" for _ in range(r.randrange(12))] + ["scorn"] * (k % 2)), "en" if k % 3 else "de", "web", 1) for k in range(400)]
    rows += [(400, " ".join(f"w{r.randrange(20_000)}" for _ in range(20_000)), "xx", "web", 1), (401, None, None, "web", 1)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(402)], LABELS)
    out = toxicity.marked_texts(frame(spark, rows), labels, F.lit(True), 100)
    assert out.count() == 402
    return out


def test_counts_are_of_all_rows(spark):
    out = marked(spark)
    count, heard = toxicity.bucket_counts(out, ["de", "en"])
    want, words_ = np.zeros_like(count), np.zeros_like(heard)
    for x in out.collect():
        codes = codes_of([x.text])[0]
        if not x.spare:
            for k in range(toxicity.KINDS):
                for c in {int(c) for c in codes[:, k] if c >= 0}:
                    want[x.q, x.fold, toxicity.BASE[k] + c] += 1
        if x.lang:
            np.add.at(words_[:, {"de": 0, "en": 1}.get(x.lang, 2)], codes[:, 0] >> (toxicity.WORD_BITS - toxicity.LANG_BITS), 1)
    want[:, :, want.sum(axis=(0, 1)) < toxicity.LEAST] = 0
    assert (count == want).all() and (heard == words_).all() and heard[:, 2].sum() == 20_000


def test_a_pass_is_the_mean_of_its_shards(spark):
    out = marked(spark).repartition(3, "text").sortWithinPartitions("text").withColumn("part", F.spark_partition_id())
    count, _ = toxicity.bucket_counts(out, [])
    total = np.array([[out.where(f"not spare and q = {y} and fold = {f}").count() for f in range(toxicity.FOLDS)] for y in (0, 1)])
    net = toxicity.Convolution.of_counts(count, total)
    got = toxicity.trained(out.where("not spare"), net, batch=16)
    each: dict = {}
    for x in out.where("not spare").collect():
        each.setdefault(x.part, []).append(x)
    assert len(each) == 3
    trainers = []
    for rows in each.values():
        t = toxicity.Trainer(copy.deepcopy(net))
        for some in np.array_split(np.arange(len(rows)), -(-len(rows) // 16)):
            own = [rows[i] for i in some]
            t.step(*codes_of([x.text for x in own]), np.array([x.q for x in own]), np.array([x.fold for x in own]))
        trainers.append(t)
    docs = np.array([t.documents for t in trainers])
    for k, p in enumerate(got.layers()):
        assert p == pytest.approx(np.average([t.net.layers()[k] for t in trainers], axis=0, weights=docs), abs=1e-5)
    met = np.array([t.met for t in trainers])
    mean = (met[:, :, None] * [t.net.vectors for t in trainers]).sum(axis=0) / np.maximum(1, met.sum(axis=0))[:, None]
    assert got.vectors == pytest.approx(np.where(met.any(axis=0)[:, None], mean, net.vectors), abs=1e-5) and met.any(axis=0).sum() > 50
