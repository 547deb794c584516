"""The pipeline's stages, and run() against a plain version of each stage."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rungline.llm import language, quality_model
from rungline.llm.common import slices

from ..conftest import MIDDLE, SMALL
from .cases import fold, frame, lower, repeated, words


def pair(name: str, n: int, shared: int) -> tuple[str, str]:
    """Two texts of n shingles each, of which they share the first `shared`."""
    own = [f"{name}{k}" for k in range(n + 4)]
    return " ".join(own), " ".join(own[: shared + 4] + [f"{name}x{k}" for k in range(n - shared)])


def test_near_dedup_starts_at_80_percent(spark):
    """Of pairs at 0.80 and 0.82 one text stays, of pairs at 0.79 both do."""
    rows, pairs = [], {80: (180, 160), 82: (182, 164), 79: (179, 158)}
    for percent, (n, shared) in pairs.items():
        assert 100 * shared == percent * (2 * n - shared)
        for k in range(6):
            rows += [(1000 * percent + 2 * k + j, t, "en", "web", len(t)) for j, t in enumerate(pair(f"w{percent}p{k}q", n, shared))]
    docs = frame(spark, rows, extra=False)
    got = corpus_pipeline.one_of_each(spark, docs, MIDDLE)
    assert got.columns == docs.columns
    ids = {r.doc_id for r in got.collect()}
    for percent, each in ((80, 6), (82, 6), (79, 12)):
        assert sum(i // 1000 == percent for i in ids) == each


def good(docs, labels, rows):
    """The rows of the quality stage: every text is scored alone by the model that the stage learns."""
    model = quality_model.learn(docs, labels, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0)
    score = lambda t: [model.score(quality_model.term_counts(block, off))[0] for _, block, off in slices(pa.array([t], pa.string()))][0]
    return [r for r in rows if score(r.text) >= 0.3]


def identified(docs, rows):
    model = language.learn(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2)
    names, ways = sorted(model.dictionaries), language.compressors(model)
    return [r for r in rows if not language.predicted(r.text, names, ways, model.margin)[2]]


def first_of_each(rows):
    """One row for each component of pairs at 0.8, by comparing all pairs of sets; ids are distinct here."""
    sets = {}
    for r in rows:
        w = words(lower(r.text))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [r for r in rows if root[r.doc_id] == r.doc_id]


def ids_of(rows):
    return sorted(r.doc_id for r in rows)


def test_run_equals_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    kept = good(docs, labels, docs.collect())
    part = docs.where(F.col("doc_id").isin(ids_of(kept)))
    assert ids_of(corpus_pipeline.good_quality(spark, docs, SMALL).collect()) == ids_of(kept)
    kept = identified(part, kept)
    assert ids_of(corpus_pipeline.known_language(spark, part, SMALL).collect()) == ids_of(kept)
    kept = first_of_each(kept)
    part = docs.where(F.col("doc_id").isin(ids_of(kept)))
    assert 50 < len(kept) < docs.count() and not [r for r in kept if not words(r.text)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in kept:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((r.doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cut, cut[1:], strict=False)))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


@pytest.mark.parametrize("rows", [repeated(), []])
def test_stages_of_awkward_tables(spark, rows):
    """Null and repeated ids, empty and long texts, extra columns with the names that stages use, and no rows."""
    docs = frame(spark, rows).withColumns({c: F.lit("x") for c in ("__score", "__p", "__id", "__hash", "__n", "__own", "__h")})
    for stage in (corpus_pipeline.good_quality, corpus_pipeline.known_language, corpus_pipeline.one_of_each):
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns and got.count() <= len(rows)
    assert (corpus_pipeline.packed(spark, docs, SMALL).count() >= len(rows)) and fold(13, 4) in range(4)
