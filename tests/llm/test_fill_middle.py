"""Operator 11 against a plain version."""

from __future__ import annotations

import glob
import hashlib
import os
import re

import duckdb

from rungline.llm import fill_middle, queries

from ..conftest import MIDDLE, SMALL
from .cases import frame, repeated

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, rate=100, share=50, seed="7"):
    t = text or ""
    units = UNIT.findall(t)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < share:
        return n, "spm", pre, mid, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", pre, mid, f"<P>{pre}<S>{suf}<M>{mid}"


def cases():
    rows = repeated()
    marks = ["\x1e", "\x1f", "\x1e0\x1e1\n\x1f1\x1e", "a\x1fb\n\x1ec\n\x1f\n", "\n", "\n\n\n", "no end", "end\n", "\r\n\r\n", "<P>in it", "a <S> b\n<M>", "<P", "S>x\n<", "<<P\n>M>\n", "😀\n\n𝔘\n", "line\n" * 5000, "x" * 300_000 + "\n" + "y" * 300_000]
    return rows + [(1000 + 37 * k, t, "en", None, 1) for k in range(8) for t in marks] + [(2000 + k, "one\ntwo\nthree\nfour", "en", None, 1) for k in range(60)]


def test_equals_the_plain_version(spark):
    rows = cases()
    got = fill_middle.fill_in_middle(frame(spark, rows)).withColumn("back", fill_middle.restored()).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted([(i, *plain(i, t), t or "") for i, t, *_ in rows], key=key)
    assert sorted([tuple(r) for r in got], key=key) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"} and {0, 1, 4} <= {w[1] for w in want}


def test_rates(spark):
    rows = [(k, f"{k}\nb\nc", "en", None, 1) for k in range(500)]
    for rate, share in ((0, 50), (30, 0), (100, 100)):
        got = {r.doc_id: tuple(r)[1:] for r in fill_middle.fill_in_middle(frame(spark, rows), rate, share, seed="x").collect()}
        assert got == {i: plain(i, t, rate, share, "x") for i, t, *_ in rows}


def test_units_are_a_parameter(spark):
    rows = [(k, "one two  three four", "en", None, 1) for k in range(40)]
    got = fill_middle.fill_in_middle(frame(spark, rows), unit=r"\S+\s*").withColumn("back", fill_middle.restored()).collect()
    assert all(r.n == 4 and r.back == rows[0][1] for r in got) and len({(r.prefix, r.middle) for r in got}) > 8


def test_an_empty_table(spark):
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0


def test_query_equals_sql_and_restores_all(spark):
    for sf in (SMALL, MIDDLE):
        con = duckdb.connect()
        for f in glob.glob(f"{sf}/documents.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        got = sorted(tuple(r) for r in queries.op11_fill_in_middle(spark, sf).collect())
        assert got == sorted(con.sql(queries.ORACLE["op11_fill_in_middle"]).fetchall())
        texts = dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
        assert all(r[-1] == hashlib.sha256(texts[r[0]].encode()).hexdigest() for r in got)
