"""Look-ups of many: references of all scopes, usage with lines in files, meanings of words; pages that follow settings."""

from __future__ import annotations

import hashlib
import json
import os

import pytest

from rungline.plans import lookups
from rungline.plans.project import Project
from rungline.sinks import folder, pages
from rungline.sources import l5x

from .test_folder import files, times
from .test_project import PROJECT

NAMED = PROJECT.replace('Name="Fault" DataType="BIT" Target="h" BitNumber="1"/>', 'Name="Fault" DataType="BIT" Target="h" BitNumber="1"><Description><![CDATA[what failed]]></Description></Member>').replace('<Parameters>\n', '<Description><![CDATA[a device]]></Description><Parameters>\n', 1)


@pytest.fixture(scope="module")
def p(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lookups")
    (root / "F1.L5X").write_text(NAMED, encoding="utf-8")
    return Project(l5x.read_elements(spark, str(root)).cache())


def one(p):
    return p.controllers.first().project


def wanted(spark, p, rows):
    return spark.createDataFrame([(one(p), *r) for r in rows], "project string, tag string, program string")


def test_references_of_every_scope(p):
    got = {(r.scope, r.tag, r.owner, r.routine, r.n, r.is_write, r.instruction, r.operand) for r in p.references.where("lower(tag) IN ('in', 'obj', 'zone1', 'cnt')").collect()}
    assert ("aoi:Dev", "In", "AOI Dev", "Logic", 0, False, "XIC", "In") in got and ("aoi:Dev", "Obj", "AOI Dev", "Logic", 0, True, "OTE", "Obj.Ok") in got
    assert ("", "Zone1", "Safe", "Main", 0, True, "DEV.Obj", "Zone1.Ok") in got
    assert {(n, w) for s, t, _, r, n, w, _, _ in got if (s, t, r) == ("Area", "Cnt", "Seq")} == {(1, False), (2, True)}


def test_usage_names_the_line_in_the_file(spark, p):
    asked = wanted(spark, p, [("cnt", "Area"), ("ZONE1.nothing", None), ("zone1", None), ("Lamp", "Area"), ("Mod1:SI", "Safe"), ("gone", "Area"), ("chain", "Area"), ("zone1", None)])
    rows = p.find_usage(asked).collect()
    texts = {r.file: r.text.split("\n") for r in folder.documents(p, reports=False).collect()}
    said = {0: "// ---- Rung 0 ----", 1: "// ---- Rung 1 ----", 2: "// ---- Rung 2 ----", 3: "// ---- Rung 3 ----"}
    for r in rows:
        want = {1: "IF Cnt > 5 THEN", 2: "    Cnt := 0;"}[r.n] if r.routine == "Seq" else said[r.n]
        assert texts[r.file][r.line - 1] == want
    key = {(r.tag, r.program, r.scope, r.name, r.is_write, r.owner, r.routine, r.place, r.operand) for r in rows}
    assert len(key) == len(rows) and {r.tag for r in rows} == {"cnt", "zone1", "Lamp", "Mod1:SI"}
    assert {k[2:6] for k in key if k[0] == "Mod1:SI"} == {("Safe", "Mod1:SI", False, "Safe")}  # declared nowhere, so it is the program's
    assert ("cnt", "Area", "Area", "Cnt", True, "Area", "Seq", "#L3", "Cnt") in key and ("cnt", "Area", "Area", "Cnt", False, "Area", "Seq", "#L2", None) in key
    assert {k[4:] for k in key if k[0] == "zone1"} == {(True, "Safe", "Main", "#0", "Zone1.Ok"), (False, "Safe", "Main", "#1", None)}
    assert {r.data_type for r in rows if r.tag == "zone1"} == {"DEVT"}


def test_an_unused_tag_gives_way(spark):
    rungs = spark.createDataFrame([("A", "R", 0, "XIC(x)OTE(y);")], "program string, routine string, n long, txt string")
    tags = spark.createDataFrame([("", "x"), ("B", "X"), ("", "y")], "scope string, name string")
    q = Project.of(spark, rungs=rungs, tags=tags)
    asked = spark.createDataFrame([("P", "X", "B"), ("P", "Z", "B")], "project string, tag string, program string")
    got = q.find_usage(asked).collect()
    assert [(r.tag, r.scope, r.name, r.owner, r.file) for r in got] == [("X", "", "x", "A", None)]


def test_meanings(spark, p):
    x = one(p)
    asked = spark.createDataFrame([(x, *r) for r in [
        ("Safe", None, "Dev", True, False), ("Safe", None, "dev", False, False), ("Safe", None, "zone1.FAULT", False, False), ("Safe", None, "Zone1.Ok.More", False, False), ("Area", None, "DevInst[1].Obj.Fault", False, False),
        (None, "Dev", "obj.Ok", False, False), ("Area", None, "IF", False, True), ("Area", None, "Cnt", False, True), ("Area", None, "Nowhere", False, False), ("Spare", None, "Lamp", False, False)]],
        "project string, program string, aoi string, word string, called boolean, is_st boolean")
    got = {(r.program, r.word): r for r in p.meanings(asked).collect()}
    assert set(got) == {("Safe", "Dev"), ("Safe", "zone1.FAULT"), ("Safe", "Zone1.Ok.More"), ("Area", "DevInst[1].Obj.Fault"), (None, "obj.Ok"), ("Area", "Cnt"), ("Spare", "Lamp")}
    dev = got["Safe", "Dev"]
    assert (dev.kind, dev.name, dev.safety, dev.description) == ("instruction", "Dev", True, "a device") and {t.name for t in dev.trail} >= {"In", "Obj", "Q"}
    z = got["Safe", "zone1.FAULT"]
    assert (z.kind, z.name, z.data_type, z.scope, z.safety) == ("tag", "Zone1", "DEVT", "", True) and [tuple(t) for t in z.trail] == [("Fault", "BIT", "what failed")]
    assert [tuple(w) for w in z.writes] == [("Safe", "Main", "DEV.Obj", "Zone1.Ok", [0])] and [tuple(w) for w in z.reads] == [("Safe", "Main", [1])] and z.used and not z.more
    assert [t.name for t in got["Safe", "Zone1.Ok.More"].trail] == ["Ok"]
    assert got["Area", "DevInst[1].Obj.Fault"].data_type == "Dev[3,4]" and [t.name for t in got["Area", "DevInst[1].Obj.Fault"].trail] == ["Obj", "Fault"]
    assert (got[None, "obj.Ok"].kind, got[None, "obj.Ok"].name, got[None, "obj.Ok"].data_type) == ("parameter", "Obj", "DEVT")
    assert got["Spare", "Lamp"].scope == ""


def test_first_places_are_six(spark):
    rungs = spark.createDataFrame([("A", f"R{k:02}", n, "XIC(x)OTE(y);") for k in range(9) for n in range(3)], "program string, routine string, n long, txt string")
    tags = spark.createDataFrame([("", "x"), ("", "y"), ("", "idle")], "scope string, name string")
    q = Project.of(spark, rungs=rungs, tags=tags)
    got = {r.name: r for r in lookups.first_places(q).collect()}
    assert [r.routine for r in got["x"].reads] == [f"R{k:02}" for k in range(6)] and got["x"].reads[0].ns == [0, 1, 2] and got["x"].more and got["x"].writes == []
    asked = spark.createDataFrame([("P", "A", None, "Idle", False, False)], "project string, program string, aoi string, word string, called boolean, is_st boolean")
    (idle,) = q.meanings(asked).collect()
    assert (idle.used, idle.more, idle.writes, idle.reads) == (False, False, [], [])


def test_every_word_has_one_meaning(p):
    w = lookups.words(p)
    got = p.meanings()
    assert got.count() == got.select("project", "program", "aoi", "word", "called", "is_st").distinct().count() > 10
    assert got.join(w, ["project", "word", "called", "is_st"], "left_anti").count() == 0


def test_index_and_order(spark, p):
    text = {r.file: r.text for r in pages.documents(p, (pages.cross_reference, pages.instructions)).collect()}
    assert [x.split(" | ")[0] for x in text["crossref.md"].strip().split("\n")[2:]] == ["| Controller tags", "| Program Area", "| Program Safe", "| AOI Dev"]
    assert "## In\n- read AOI Dev/Logic: #0\n## Obj\n- write AOI Dev/Logic: #0 OTE Obj.Ok\n" in text["xref/AOI_Dev.md"]
    assert "- write Area/seq: #L3" in text["xref/Area.md"].replace("Seq", "seq")
    assert text["instructions.md"].startswith("## Dev (safety)\na device\n- logic: Logic RLL\n- call: Dev(Instance, In, Obj)\n") and "- parameter | Obj | DEVT | InOut | required | " in text["instructions.md"]
    rungs = spark.createDataFrame([("A", "R", 0, "XIC(B)XIC(_b)XIC(a)XIC(A10)XIC(A2);")], "program string, routine string, n long, txt string")
    (page,) = [r.text for r in pages.documents(Project.of(spark, rungs=rungs), (pages.cross_reference,)).collect() if r.file == "xref/A.md"]
    assert [x.split(" ")[1] for x in page.split("\n") if x.startswith("## ")] == ["_b", "a", "A10", "A2", "B"]


def test_settings_remake_only_their_pages(spark, p, tmp_path):
    root = f"{tmp_path}/out"
    folder.export(p, root)
    was, at = files(root), times(root)
    assert pages.stale({}, {"device": "", "sinks": []}) == [] and folder.resettle(spark, root, {}, {"other": 1}).count() == 0
    new = {"names": "Lamp|Never"}
    done = folder.resettle(spark, root, {}, new).collect()
    now = files(root)
    changed = {os.path.basename(f) for f in now if now[f] != was.get(f)}
    assert changed <= {"bypasses.md", "unconsumed.md", "unproduced.md", "safety.md", "manifest.json", "export.json"} and "bypasses.md" in changed
    assert {os.path.basename(f) for f, t in times(root).items() if at.get(f) != t} == changed | {"export.json"} and {r.action for r in done} >= {"write"}
    # what an export under the new settings would say, and the manifest knows it
    (top,) = {f.split("/")[0] for f in now if "/" in f}
    want = {f"{top}/{r.file}": r.text for r in pages.documents(folder.read_model(spark, root, new), tuple(pages.BY_SETTINGS)).collect()}
    assert {f: now[f] for f in want} == want and not {f for f in now if os.path.basename(f) in {n for names, _ in pages.BY_SETTINGS.values() for n in names}} - set(want)
    entries = json.loads(now[f"{top}/manifest.json"])["files"]
    assert {e["file"]: e["hash"] for e in entries} == {f: hashlib.sha1(now[f].encode()).hexdigest() for f in now if f not in ("export.json", f"{top}/manifest.json")}
    assert {e["file"] for e in entries if e["editable"]} == {f for f in now if f.endswith((".rll", ".st"))}
