"""The second half of binary projects: awkward records, and one Project over both kinds of file."""

from __future__ import annotations

import struct

from rungline.plans.project import Project
from rungline.sources import acd_info, acd_text, l5x, projects, synth_acd
from rungline.sources.synth_acd import counted, ids


def test_counted_texts():
    long = "x" * 70_000
    huge = b"\xff\xfe\xff\xff\xff\xff" + struct.pack("<I", len(long)) + long.encode("utf-16-le")
    assert acd_text.counted_text(counted("añ"), 0) == ("añ", 8) and acd_text.counted_text(counted("y" * 300), 0)[0] == "y" * 300
    assert acd_text.counted_text(huge, 0)[0] == long and acd_text.counted_text(counted(""), 0) == ("", 4)
    assert acd_text.counted_text(counted("cut off")[:9], 0)[0] == "cu" and acd_text.counted_text(b"\xff\xfe\xff\xff\x01", 0) is None and acd_text.counted_text(b"plain", 0) is None


def test_lists_are_cut_at_the_end():
    assert acd_text.id_list(ids(5, 6, 7), 0) == [5, 6, 7] and acd_text.id_list(ids(5, 6, 7)[:-1], 0) == [5, 6] and acd_text.id_list(ids(), 0) == []


def test_products_are_named_by_version():
    assert acd_info.product_name("RSLogix 5000 v20.04") == "RSLogix 5000 v20.04" and acd_info.product_name("RSLogix 5000 v33.00") == "Studio 5000 Logix Designer v33.00"
    assert acd_info.product_name("none") == "none" and acd_info.product_name(None) is None


XML = '<RSLogix5000Content TargetType="Controller"><Controller Name="X"><Programs><Program Name="Q" MainRoutineName="Main"><Routines><Routine Name="Main" Type="RLL"><RLLContent><Rung><Text>XIC(p)OTE(q);</Text></Rung></RLLContent></Routine></Routines></Program></Programs></Controller></RSLogix5000Content>'


def test_both_kinds_of_file_in_one_project(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "made" / "copies").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "B.ACD").write_bytes(synth_acd.container(synth_acd.files_of(0, [(3, 7), (10, 21), (11, 8)])))
    (tmp_path / "X.L5X").write_text(XML)
    (tmp_path / "made" / "manifest.json").write_text("{}")
    (tmp_path / "made" / "copies" / "Y.L5X").write_text(XML)  # written by an export: left out
    p = Project.read(spark, str(tmp_path))
    got = {(r.project.rsplit("/", 1)[1], r.program, r.routine, r.n, r.txt) for r in p.rungs.collect()}
    assert got == {("X.L5X", "Q", "Main", 0, "XIC(p)OTE(q);")} | {("B.ACD", f"P{i}", "Main", n, t) for i, z in ((3, 7), (10, 21), (11, 8)) for n, t in ((0, f"XIC(In{i}.B0)OTE(In{i}.B{z % 12});"), (1, "XIC(@00000bad@)NOP();" if z % 7 == 0 else "NOP();"))}
    assert {(r.task, r.ord, r.program) for r in p.scheduled.collect()} == {("T10", 0, "P10"), ("T10", 1, "P11")}
    assert {r.controller for r in p.controllers.collect()} == {"X", "C0"}
    assert sorted((r.aoi, r.ord, r.param) for r in p.aoi_args.where("aoi = 'A10'").collect()) == [("A10", 1, "p2"), ("A10", 2, "p0")]
    assert {(r.type_name, r["name"], r.target) for r in p.members.where("name = 'B0'").collect()} == {(f"U{i}", "B0", "Z0") for i in (3, 10, 11)}
    assert {r.undecoded for r in p.routines.where("routine = 'Seq'").collect()} == {None}
    assert set(projects.COLUMNS) <= set(vars(p)) and l5x.controllers(p.elements).count() == 0


def test_members_without_text_or_index(spark):
    """A container with no more than an object table has programs and nothing else."""
    files = synth_acd.files_of(0, [(3, 7)])
    raw = spark.createDataFrame([("K", bytearray(synth_acd.container({k: files[k] for k in ("Comps.Dat",)})))], "path string, content binary")
    from rungline.sources import acd

    t = projects.binary_tables(acd.members_in(raw))
    assert [r.program for r in t["programs"].collect()] == ["P3"] and t["tags"].count() == 0 and t["lines"].count() == 0
    assert {r.undecoded for r in t["routines"].where("type = 'ST'").collect()} == {"no source text stored"} and [r.txt for r in t["rungs"].collect()] == ["", ""]
