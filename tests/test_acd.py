"""Binary projects from bytes made here: container, records, objects, ladder text, comments."""

from __future__ import annotations

import gzip
import struct

import pytest

from rungline.sources import acd


def record(payload: bytes, mark: int = 0xFAFA) -> bytes:
    return struct.pack("<HI", mark, 6 + len(payload)) + payload


def dat(*records: bytes) -> bytes:
    return b"\0" * 20 + struct.pack("<I", len(records)) + b"".join(records)


def comp(id_, parent, name, kind, body=b"", type_code=0, keys=(0, 0)) -> bytes:
    rest = bytearray(max(120, 0x4E + len(body)))
    struct.pack_into("<H", rest, 8, kind)
    struct.pack_into("<II", rest, 10, *keys)
    struct.pack_into("<H", rest, 62, type_code)
    if body:
        struct.pack_into("<I", rest, 0x4A, 4 + len(body))
        rest[0x4E : 0x4E + len(body)] = body
    return record(b"\0" * 16 + struct.pack("<II", id_, parent) + name.encode("utf-16-le").ljust(124, b"\0") + bytes(rest))


def text(region, what) -> bytes:
    raw = what.encode("utf-16-le")
    return record(b"\0" * 6 + struct.pack("<I", region) + b"Rung NT\0" + b"\0" * 33 + struct.pack("<I", len(raw)) + raw)


def comment(parent, member, rung, what) -> bytes:
    return record(b"\0" * 6 + struct.pack("<HHIII", 1, 0, parent, member, rung) + b"\0" * 22 + what.encode() + b"\0")


def link(region, key) -> bytes:
    return b"\0\0\x02\x01\0\x01" + struct.pack("<I", key) + b"\0" * 4 + struct.pack("<I", region) + b"\0" * 6


def container(**files: bytes) -> bytes:
    out, entries = b"head\r\n2024-01-02 10:00 saved\r\n", b""
    for name, data in files.items():
        entries += name.replace("_", ".").encode("utf-16-le").ljust(520, b"\0") + struct.pack("<II", len(data), len(out))
        out += data
    return out + entries + struct.pack("<II", len(files), 0x0E7C)


REGIONS = b"".join(struct.pack("<IIII", owner, order, 0, region) for owner, order, region in ((30, 2, 72), (30, 1, 71), (30, 3, 73)))
COMPS = dat(
    comp(1, 0, "RxProgramCollection", 0), comp(10, 1, "Old", 0x13), comp(10, 1, "Area", 0x13), comp(20, 10, "RxRoutineCollection", 0),
    comp(30, 20, "Main", 0x32, type_code=1, keys=(5, 6)), comp(31, 20, "Seq", 0x32, type_code=4), comp(0xABCDEF01, 0, "Start", 0x3E), comp(0x0F2C60CB, 0, "Mod1", 0xA4),
    comp(0xABCDEF02, 0, "&0f2c60cb:I", 0x3E), comp(40, 0, "Region Map", 1, REGIONS), comp(41, 0, "Region Map", 1),
)
TEXTS = dat(text(71, "XIC(@abcdef01@)OTE(@ABCDEF02@.Data);"), b"\x01\x02\x03", text(72, "old"), text(72, "XIC(@00000bad@);"))
NOTES = dat(comment(5, 6, 0, "the routine"), comment(5, 6, 9 << 16, "old"), comment(5, 6, 9 << 16, "first\r\nnote "))
FILE = container(Comps_Dat=gzip.compress(COMPS), SbRegion_Dat=TEXTS, RegnLink_Dat=link(71, 0x70009) + link(72, 8), Comments_Dat=NOTES)


def test_directories():
    assert [n for n, _, _ in acd.directory(FILE)] == ["Comps.Dat", "SbRegion.Dat", "RegnLink.Dat", "Comments.Dat"]
    for bad in (b"short", b"\0" * 600, container(Other_Dat=b"x"), FILE[:-8] + struct.pack("<II", 2000, 0), container(Comps_Dat=b"x")[30:]):
        with pytest.raises(ValueError):
            acd.directory(bad)


def test_records_go_on_after_a_gap():
    kept = [r for _, _, r in acd.dat_records(dat(record(b"a"), record(b"dead", 0xFEFE)) + b"\x07\x08" + record(b"b"))]
    assert [bytes(r[6:]) for r in kept] == [b"a", b"b"]
    assert [m for _, m, _ in acd.dat_records(dat(record(b"a"), record(b"dead", 0xFDFD)), every=True)] == [0xFAFA, 0xFDFD]
    assert list(acd.dat_records(b"")) == []


def test_attributes_are_cut_at_the_end():
    body = b"\0" * 78 + struct.pack("<I", 3) + struct.pack("<II", 7, 2) + b"ab" + struct.pack("<II", 8, 99) + b"rest"
    assert acd.attributes(body) == {7: b"ab", 8: b"rest"} and acd.attributes(b"") == {}


def test_a_project(spark, tmp_path):
    (tmp_path / "P.ACD").write_bytes(FILE)
    (tmp_path / "notes.txt").write_text("none")
    members = acd.read_members(spark, str(tmp_path)).cache()
    assert [r.line for r in acd.save_log(spark, str(tmp_path)).collect()] == ["2024-01-02 10:00 saved"]
    c = acd.comps(members).cache()
    assert {r.id: r["name"] for r in c.collect()}[10] == "Area" and c.count() == 10
    assert {r.what: r.kind for r in acd.kinds(c).collect()}["Routine"] == 0x32 and {r.what: r.kind for r in acd.kinds(c).collect()}["Task"] == 0x12
    assert sorted((r.program, r.routine, r.type) for r in acd.routines(c).collect()) == [("Area", "Main", "RLL"), ("Area", "Seq", "ST")]
    got = [(r.routine, r.n, r.txt, r.comment, r.unresolved) for r in acd.rungs(members, c).orderBy("n").collect()]
    assert got == [("Main", 0, "XIC(Start)OTE(Mod1:I.Data);", "first\nnote", 0), ("Main", 1, "XIC(@00000bad@);", None, 1), ("Main", 2, "", None, 0)]
    assert [r.text for r in acd.comments(members).where("rung_key IS NULL").collect()] == ["the routine"]
    assert acd.records(members, "comments.dat").select("declared").first().declared == 3
