"""Exports to a folder: idempotent, edits kept, vanished files removed, a crash leaves the old manifest, the tables come back."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from rungline.plans.project import Project
from rungline.sinks import folder


def project(spark, rungs, lines=(), name="/in/Line 1.L5X", counted=False):
    own = lambda rows, extra: spark.createDataFrame([(name, *r) for r in rows], "project string, program string, routine string, n long, txt string" + extra)
    r = own(rungs, "")
    kinds = {(p, x): "RLL" for p, x, *_ in rungs} | {(p, x): "ST" for p, x, *_ in lines}
    routines = spark.createDataFrame([(name, p, x, t) for (p, x), t in kinds.items()], "project string, program string, routine string, type string")
    programs = spark.createDataFrame([(name, p, "Main") for p in {p for p, _ in kinds}], "project string, program string, main_routine string")
    tags = spark.createDataFrame([(name, "", "a", "BOOL"), (name, "Safe", "b", "DINT")], "project string, scope string, name string, data_type string")
    p = Project.of(spark, rungs=r, lines=own(lines, ""), routines=routines, programs=programs, tags=tags)
    if counted is False:  # tag lists without counts of uses, which take long to plan
        p.kept_uses = spark.createDataFrame([], "project string, scope string, program string, base string, is_write boolean")
    return p


FIRST = [("Area", "Main", 0, "XIC(a)OTE(b);"), ("Area", "Main", 1, "XIC(b)OTE(c);"), ("Area", "Old", 0, "NOP();"), ("Sa:fe", "Main", 0, "XIC(c)OTE(d);")]
TEXT = [("Area", "Seq", 0, "x := 1;"), ("Area", "Seq", 1, "y := x;")]


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def counts(df):
    return {r.action: r.n for r in df.collect()}


def times(root):
    return {f: os.stat(os.path.join(root, f)).st_mtime_ns for f in files(root)}


def test_an_export_over_time(spark, tmp_path):
    root = f"{tmp_path}/out"
    first = counts(folder.export(project(spark, FIRST, TEXT), root, reports=False))
    there = files(root)
    (top,) = {f.split("/")[0] for f in there if "/" in f}
    assert set(first) == {"write"} and top.startswith("Line 1-") and first["write"] == len(there) - 2  # the manifest and the summary
    assert there[f"{top}/Programs/Sa_fe/Main.rll"].endswith("OTE(d);\n") and "y := x;" in there[f"{top}/Programs/Area/Seq.st"]
    manifest = json.loads(there[f"{top}/manifest.json"])
    assert {e["file"] for e in manifest["files"] if e["editable"]} == {f"{top}/Programs/{x}" for x in ("Area/Main.rll", "Area/Old.rll", "Area/Seq.st", "Sa_fe/Main.rll")}

    # the same again: no file is touched but the summary
    was = times(root)
    second = counts(folder.export(project(spark, FIRST, TEXT), root, reports=False))
    assert set(second) == {"same"} and {f for f, t in times(root).items() if was[f] != t} == {"export.json"}
    assert json.loads(files(root)["export.json"]) == {"written": 0, "removed": 0, "bytes": 0}

    # one routine edited by hand, one only laid out anew; the project changes one, loses one, and loses a program
    edit, layout = os.path.join(root, top, "Programs/Area/Main.rll"), os.path.join(root, top, "Programs/Area/Seq.st")
    with open(edit, "w") as f:
        f.write(there[f"{top}/Programs/Area/Main.rll"].replace("OTE(c)", "OTE(hand)"))
    with open(layout, "w") as f:
        f.write(there[f"{top}/Programs/Area/Seq.st"].replace("x := 1;", "x := 1;   "))
    third = counts(folder.export(project(spark, FIRST[:2], TEXT), root, reports=False))
    now = files(root)
    assert "OTE(hand)" in now[f"{top}/Programs/Area/Main.rll"] and now[f"{top}/Programs/Area/Seq.st"] == there[f"{top}/Programs/Area/Seq.st"]
    assert f"{top}/Programs/Area/Old.rll" not in now and not os.path.exists(os.path.join(root, top, "Programs/Sa_fe"))
    assert third["keep"] == 1 and third["heal"] == 1 and third["remove"] >= 2
    entry = {e["file"]: e for e in json.loads(now[f"{top}/manifest.json"])["files"]}
    assert entry[f"{top}/Programs/Area/Main.rll"]["hash"] == {e["file"]: e for e in manifest["files"]}[f"{top}/Programs/Area/Main.rll"]["hash"]
    again = counts(folder.export(project(spark, FIRST[:2], TEXT), root, reports=False))
    assert set(again) == {"same", "keep"}

    # the tables come back from the folder
    back = folder.read_model(spark, root)
    assert sorted((r.program, r.routine, r.n, r.txt) for r in back.rungs.collect()) == sorted(FIRST[:2])
    assert {(r.scope, r["name"]) for r in back.tags.collect()} == {("", "a"), ("Safe", "b")}


def test_a_crash_leaves_the_old_manifest(spark, tmp_path):
    root = f"{tmp_path}/out"
    folder.export(project(spark, FIRST), root, reports=False)
    before = files(root)
    (manifest,) = [f for f in before if f.endswith("manifest.json")]
    changed = [(p, r, n, t.replace("OTE(", "OTL(")) for p, r, n, t in FIRST]
    now = folder.documents(project(spark, changed), False)
    there = folder.read_files(spark, root)
    plan = folder.planned(now, folder.read_manifest(there), there).where("action IN ('write', 'heal', 'remove')")
    bad = plan.withColumn("text", F.when(F.col("file").endswith("Old.rll"), F.raise_error(F.lit("killed"))).otherwise(F.col("text"))).where("action = 'write'").repartition(6)
    lost = spark.range(1).select(F.lit("x").alias("file"), F.raise_error(F.lit("killed")).cast("string").alias("text"), F.lit("write").alias("action"))
    with pytest.raises(Exception, match="killed"):
        folder._write(bad.unionByName(lost), root, "export.json")
    half = files(root)
    assert half[manifest] == before[manifest]
    # every file is whole: the old text or the new one
    new = {r.file: r.text for r in now.collect()}
    assert all(half[f] in (before[f], new.get(f)) for f in before if f != "export.json")
    # the next export finishes; what was already written isn't taken for an edit
    done = counts(folder.export(project(spark, changed), root, reports=False))
    after = files(root)
    assert "keep" not in done and all(after[f] == t for f, t in new.items())


def test_health(spark, tmp_path):
    root = f"{tmp_path}/out"
    sources = spark.sql("SELECT '/in/Line 1.L5X' AS project, 10L AS size, timestamp'2024-01-01' AS modified UNION ALL SELECT '/in/Other.L5X', 1L, timestamp'2024-01-01'")
    state = lambda s: {r.project: r.state for r in folder.health(s, folder.read_files(spark, root)).collect()}
    assert set(state(sources).values()) == {"missing"}
    folder.export(project(spark, FIRST[:1], counted=True), root, sources)
    assert state(sources) == {"/in/Line 1.L5X": "ok", "/in/Other.L5X": "missing"}
    assert state(sources.withColumn("size", F.lit(11)))["/in/Line 1.L5X"] == "stale"
    (manifest,) = [f for f in files(root) if f.endswith("manifest.json")]
    with open(os.path.join(root, manifest), "w") as f:
        f.write("{")
    assert state(sources)["/in/Line 1.L5X"] == "broken"
