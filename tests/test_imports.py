"""Edited routine files become import files with a report; overlaps by the index of prefixes; verdicts on devices."""

from __future__ import annotations

import itertools
import os
import random

from pyspark.sql import functions as F

from rungline.operators import facts, safety
from rungline.sinks import folder, imports
from rungline.sources import l5x

from .test_folder import FIRST, TEXT, counts, files, project


def edit(root, name, change):
    (path,) = [os.path.join(root, f) for f in files(root) if f.endswith(name)]
    text = open(path).read()
    assert change(text) != text
    with open(path, "w") as f:
        f.write(change(text))


def test_edits_become_import_files(spark, tmp_path):
    root = f"{tmp_path}/out"
    folder.export(project(spark, FIRST, TEXT), root, reports=False)
    (top,) = {f.split("/")[0] for f in files(root) if "/" in f}
    assert imports.package(spark, root).count() == 0
    assert files(root)[f"{top}/edits/IMPORT_REPORT.md"] == "# Imports of /in/Line 1.L5X\n\nNo edited routines.\n"

    edit(root, "Area/Main.rll", lambda t: t.replace("XIC(b)OTE(c);", "XIC(b)FOO(a)OTE(a);\nJSR(Gone);").replace("@routine Main", "@routine Other"))
    edit(root, "Area/Seq.st", lambda t: t.replace("y := x;", "y := x;\n\ny := 2;"))
    edit(root, "Area/Old.rll", lambda t: t.replace("NOP();", "   NOP();"))  # layout alone: no edit
    got = {r.file.split("/", 2)[2]: r for r in imports.package(spark, root).collect()}
    assert set(got) == {"Area/Main.rll", "Area/Seq.st"}
    main, seq = got["Area/Main.rll"], got["Area/Seq.st"]
    assert (main.before, main.after, main.changed, main.skipped) == (2, 3, 2, None) and (seq.before, seq.after, seq.changed) == (2, 4, 2)
    said = [(i.n, i.what) for i in main.issues]
    assert said[0] == (None, "the head names Other, but the file is of Main, which counts")
    assert {(1, "unknown instruction FOO"), (2, "no such routine in the program: Gone"), (0, "declared nowhere: b")} <= set(said)
    there = files(root)
    xml = l5x.elements_of("x", there[f"{top}/edits/Area__Main.L5X"].encode())
    assert [r["text"] for r in xml if r["element"] == "Text"] == ["XIC(a)OTE(b);", "XIC(b) FOO(a) OTE(a);", "JSR(Gone);"]  # what is unchanged keeps its text
    report = there[f"{top}/edits/IMPORT_REPORT.md"]
    assert "## Area/Main\n" in report and "- Rungs: 2 → 3 (2 new or changed)" in report and "  - rung 2: no such routine in the program: Gone" in report

    # the edit taken back: its import file goes, and a second run writes nothing
    edit(root, "Area/Seq.st", lambda t: t.replace("\n\ny := 2;", ""))
    imports.package(spark, root)
    assert f"{top}/edits/Area__Seq.L5X" not in files(root) and f"{top}/edits/Area__Main.L5X" in files(root)
    # a later export keeps the edit and the import files
    assert counts(folder.export(project(spark, FIRST, TEXT), root, reports=False))["keep"] == 1 and f"{top}/edits/Area__Main.L5X" in files(root)


def test_files_that_cannot_be_packed(spark):
    sha = lambda t: F.sha1(F.lit(t).cast("binary"))
    text = "// @aoi Dev\n// @routine Logic\n// @type RLL\n\nXIC(In)OTE(Out);\n"
    base = spark.range(1).select(F.lit("T-1").alias("folder"), F.lit("src").alias("source"), sha("old").alias("hash"), F.lit("old").alias("content"), F.lit("RLL").alias("type"))
    no = F.lit(None).cast("string")
    m = base.select("*", F.lit("T-1/AOIs/Dev/Logic.rll").alias("file"), no.alias("program"), F.lit("Dev").alias("aoi"), F.lit("Logic").alias("routine"), F.lit(True).alias("editable"))
    m = m.unionByName(base.select("*", F.lit("T-1/Programs/P/R.rll").alias("file"), F.lit("P").alias("program"), no.alias("aoi"), F.lit("R").alias("routine"), F.lit(False).alias("editable")))
    there = spark.createDataFrame([("T-1/AOIs/Dev/Logic.rll", text), ("T-1/Programs/P/R.rll", "no head")], "file string, text string")
    made = imports.prepared(project(spark, FIRST, name="src"), there, m)
    got = {r.file: r for r in made.edits.collect()}
    assert {f: r.skipped for f, r in got.items()} == {"T-1/AOIs/Dev/Logic.rll": imports.OF_INSTRUCTION, "T-1/Programs/P/R.rll": imports.NOT_READ}
    assert all(r.target is None and r.before is None for r in got.values()) and made.xml.count() == 0
    assert "**Not packed:**" in made.report.first().text and "routine is named" in made.report.first().text


def test_overlaps_equal_all_pairs(spark):
    """The index of prefixes against a comparison of every two paths, with long tags, near misses and several scopes."""
    rng = random.Random(5)
    names = ["a", "a.b", "a[*]", "a[*].b", "a.bb", "a.b.c", "ab", "a.b[*].c", "ab.b", "x.y", "x.y.z"]
    rows = lambda k: [(s, n) for s in ("", "p|P", "p.L5X|P") for n in rng.sample(names, k)]
    mine, other = [*rows(8), ("", "only.mine")], rows(7)
    keyed = lambda r: facts.keyed(spark.createDataFrame(r, "scope string, operand string").withColumn("base", F.regexp_extract("operand", r"^\w+", 0)), F.col("scope"))
    holds = lambda x, y: x == y or (y.startswith(x) and y[len(x)] in ".[")
    want = {(f"{s}|{a}", f"{s}|{b}") for (s, a), (t, b) in itertools.product(mine, other) if s == t and (holds(a, b) or holds(b, a))}
    got = [(r.use_key, r.other_key) for r in facts.overlap_pairs(keyed(mine), keyed(other)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    met = {r.use_key for r in facts.partners(keyed(mine), keyed(other), "left_semi").collect()}
    lost = {r.use_key for r in facts.without_partner(keyed(mine), keyed(other)).collect()}
    assert met == {a for a, _ in want} and lost == {f"{s}|{a}" for s, a in mine} - met and lost


def test_verdicts_on_devices(spark):
    out = "struct<operand:string,consumers:bigint,sink:string,hops:int,bypassed:bigint,places:array<struct<project:string,program:string,routine:string,n:bigint>>,chain:array<string>>"
    at = [("p", "A", "R", 1), ("p", "A", "R", 4)]
    ok, idle, blind, gone = ("D.Ok", 2, "M:O.1", 1, 0, [], []), ("D.Bad", 0, None, None, 0, [], []), ("D.Ok", 1, None, None, 0, [], []), ("D.Ok", 1, "M:O.1", 1, 5, at, [])
    rows = [(1, [ok, idle]), (2, [idle]), (3, None), (4, [blind, idle]), (5, [gone]), (6, [idle, idle])]
    d = spark.createDataFrame(rows, f"k int, outputs array<{out}>")
    said = lambda s: {r.k: r.problems for r in safety.judged(d, s).collect()}
    plain = {1: [], 2: ["no output is read"], 3: ["writes no output"], 4: ["reaches no output"], 5: [".Ok bypassed at A/R#1, A/R#4 and 3 more"], 6: ["no output is read"]}
    assert said(safety.Settings()) == plain
    assert said(safety.Settings(result=r"\.Bad$")) == plain | {1: ["not consumed"], 2: ["not consumed"], 4: ["not consumed"]}


def test_members_written_twice_are_one_output(spark):
    """An instruction that writes a member on two paths has one output with all consumers and bypasses, places in order."""
    unit = lambda n: ("p", "A", "R", n)
    row = lambda n, instruction, operand, w, via: (*unit(n), 0, instruction, operand, w, via, 0, "p||" + operand.lower(), "p||dev")
    uses = spark.createDataFrame([row(0, "DEV", "Dev.Ok", True, "Obj"), row(0, "DEV", "DEV.OK", True, "Obj2"), row(1, "XIC", "Dev.Ok", False, None), row(2, "XIC", "Dev", False, None), row(2, "XIC", "Dev.Ok", False, None)],
                                 "project string, program string, routine string, n long, pos int, instruction string, operand string, is_write boolean, via string, idx int, use_key string, scope_base string")
    aois = spark.createDataFrame([("p", "DEV")], "project string, aoi string")
    args = spark.createDataFrame([("p", "DEV", 1, "Obj", "InOut"), ("p", "DEV", 2, "Obj2", "InOut")], "project string, aoi string, ord int, param string, usage string")
    reached = spark.createDataFrame([(*unit(0), "p||dev.ok", "M:O.1", 2, ["p||dev.ok", "p||m"])], "project string, program string, routine string, n long, use_key string, sink string, hops int, chain array<string>")
    bypassed = spark.createDataFrame([(*unit(k), "p||dev", "p||dev.ok") for k in range(9, 4, -1)], "project string, program string, routine string, n long, scope_base string, use_key string")
    (d,) = safety.devices(uses, aois, args, reached, bypassed).collect()
    (o,) = d.outputs
    assert (o.consumers, o.sink, o.hops, o.bypassed, [p.n for p in o.places], o.chain) == (2, "M:O.1", 2, 5, [5, 6, 7], ["p||dev.ok", "p||m"])
