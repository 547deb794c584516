"""The golden project: XML in, facts and findings out."""

from __future__ import annotations

import hashlib

import pytest

from rungline.operators import facts
from rungline.plans.project import Project
from rungline.sinks import pages
from rungline.sinks import routines as files
from rungline.sources import l5x
from rungline.streaming import incremental


def rung_xml(n, text, comment=""):
    note = f"<Comment><![CDATA[\n{comment}]]></Comment>" if comment else ""
    return f'<Rung Number="{n}" Type="N">{note}\n<Text>\n<![CDATA[{text}]]>\n</Text>\n</Rung>'


def tag_xml(name, kind="BOOL", more=""):
    return f'<Tag Name="{name}" TagType="Base" DataType="{kind}" {more}/>'


AREA = ["XIC(Start)[XIC(Run) ,]XIO(Stop)OTE(Run);", "JSR(Seq,0);", "XIC(Start)AFI()OTE(Lamp);", "XIC(Cnt.0)XIO(Cnt.0)OTE(Never);", "[XIC(Stop) ,XIO(Stop)]OTE(Always);"]
SAFE = ["Dev(DevInst,Mod1:SI.Pt00,Zone1)OTE(Mod1:SO.Pt00);", "XIC(Zone1.Ok)OTE(Chain);"]
SEQ = ["// step logic", "IF Cnt > 5 THEN", "    Cnt := 0;", "END_IF;"]
PROJECT = f"""﻿<?xml version="1.0" encoding="UTF-8"?>
<RSLogix5000Content SoftwareRevision="33.01" TargetType="Controller" TargetName="F1"><Controller Use="Target" Name="F1">
<DataTypes><DataType Name="DEVT"><Members><Member Name="Ok" DataType="BIT" Target="h" BitNumber="0"/><Member Name="Fault" DataType="BIT" Target="h" BitNumber="1"/></Members></DataType></DataTypes>
<SafetyInfo><SafetyTagMap> Lamp=SLamp, A=B </SafetyTagMap></SafetyInfo>
<Modules><Module Name="Local" ParentModule="Local"/><Module Name="Mod1" ParentModule="Local" Inhibited="true"/></Modules>
<AddOnInstructionDefinitions><AddOnInstructionDefinition Name="Dev" Class="Safety"><Parameters>
<Parameter Name="EnableIn" Usage="Input" DataType="BOOL" Required="false"/><Parameter Name="EnableOut" Usage="Output" DataType="BOOL"/>
<Parameter Name="In" Usage="Input" DataType="BOOL" Required="true"/><Parameter Name="Obj" Usage="InOut" DataType="DEVT" Required="true"/><Parameter Name="Q" Usage="Output" DataType="BOOL" Required="false"/>
</Parameters><Routines><Routine Name="Logic" Type="RLL"><RLLContent>{rung_xml(0, "XIC(In)OTE(Obj.Ok);")}</RLLContent></Routine></Routines></AddOnInstructionDefinition></AddOnInstructionDefinitions>
<Tags>{tag_xml("Lamp")}{tag_xml("Zone1", "DEVT", 'Class="Safety"')}{tag_xml("DevInst", "Dev", 'Dimensions="3 4"')}</Tags>
<Programs><Program Name="Area" MainRoutineName="Main"><Tags>{tag_xml("Start")}{tag_xml("Stop")}{tag_xml("Run")}{tag_xml("Cnt", "DINT")}</Tags><Routines>
<Routine Name="Main" Type="RLL"><RLLContent>{"".join(rung_xml(n, t, "first &" if n == 0 else "") for n, t in enumerate(AREA))}</RLLContent></Routine>
<Routine Name="Seq" Type="ST"><STContent>{"".join(f'<Line Number="{n}">' + chr(10) + f"<![CDATA[{t}]]>" + chr(10) + "</Line>" for n, t in enumerate(SEQ))}<Line Number="4"><![CDATA[]]></Line></STContent></Routine>
<Routine Name="Old" Type="RLL"><RLLContent>{rung_xml(0, "NOP();")}</RLLContent></Routine></Routines></Program>
<Program Name="Safe" MainRoutineName="Main" Class="Safety"><Tags>{tag_xml("Chain")}</Tags><Routines><Routine Name="Main" Type="RLL"><RLLContent>{"".join(rung_xml(n, t) for n, t in enumerate(SAFE))}</RLLContent></Routine></Routines></Program>
<Program Name="Spare"/></Programs>
<Tasks><Task Name="Cyc" Type="CONTINUOUS"><ScheduledPrograms><ScheduledProgram Name="Area"/></ScheduledPrograms></Task>
<Task Name="SafeT" Type="PERIODIC" Rate="20" Class="Safety"><ScheduledPrograms><ScheduledProgram Name="Safe"/></ScheduledPrograms></Task></Tasks>
</Controller></RSLogix5000Content>"""


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("projects")
    (folder / "F1.L5X").write_text(PROJECT, encoding="utf-8")
    (folder / "notes.txt").write_text("no project")
    return Project(l5x.read_elements(spark, str(folder)).cache())


def test_texts_keep_their_indentation(project):
    got = project.lines.orderBy("n").collect()
    assert [r.txt for r in got] == [*SEQ, ""]
    assert [r.txt for r in project.rungs.where("program = 'Area' AND routine = 'Main'").orderBy("n").collect()] == AREA
    assert project.rungs.where("comment IS NOT NULL").first().comment == "first &"


def test_tables(project):
    e = project.elements
    assert {(r.scope, r["name"], r.safety) for r in project.tags.collect()} == {("", "Lamp", False), ("", "Zone1", True), ("", "DevInst", False), ("Area", "Start", False), ("Area", "Stop", False), ("Area", "Run", False), ("Area", "Cnt", False), ("Safe", "Chain", True)}
    assert project.tags.where("name = 'DevInst'").first().dims == [3, 4]
    assert sorted((r.task, r.program) for r in l5x.task_programs(e).collect()) == [("Cyc", "Area"), ("SafeT", "Safe")]
    assert [(r.ord, r.param) for r in project.aoi_args.orderBy("ord").collect()] == [(1, "In"), (2, "Obj")]
    assert sorted((r.standard, r.safety) for r in l5x.safety_map(e).collect()) == [("A", "B"), ("Lamp", "SLamp")]
    assert sorted((r.name, r.bit) for r in l5x.members(e).collect()) == [("Fault", 1), ("Ok", 0)]
    assert {r.module: r.inhibited for r in l5x.modules(e).collect()} == {"Local": False, "Mod1": True}
    assert l5x.tasks(e).where("task = 'SafeT'").first().rate_ms == 20


def test_uses_of_a_device_call(project):
    got = {(r.operand, r.is_write, r.via) for r in project.uses().where("program = 'Safe' AND n = 0").collect()}
    assert got == {("DevInst", True, "instance"), ("Mod1:SI.Pt00", False, "In"), ("Zone1.Ok", True, "Obj"), ("Mod1:SO.Pt00", True, None)}


def test_cross_reference_of_a_structure(project):
    got = {(r.program, r.is_write, r.instruction, tuple(r.ns)) for r in facts.cross_reference(project.uses(), ["program", "routine", "n"]).where("base = 'Zone1'").collect()}
    assert got == {("Safe", True, "DEV", (0,)), ("Safe", False, "XIC", (1,))}


def test_uses_of_structured_text(project):
    got = {(r.n, r.operand, r.is_write) for r in project.uses().where("routine = 'Seq'").collect()}
    assert got == {(1, "Cnt", False), (2, "Cnt", True)}


def test_calls_and_orphans(project):
    assert [(r.src, r.dst) for r in project.call_edges().collect()] == [("main", "seq")]
    assert [(r.program, r.routine) for r in project.orphans().collect()] == [("Area", "Old")]
    assert [r.program for r in project.unscheduled().collect()] == ["Spare"]


def test_bypasses(project):
    got = sorted((r.program, r.n, r.kind, r.operand) for r in project.bypasses().select("program", "n", "kind", "operand").collect())
    said = {r.n: (r.affected, r.safety) for r in project.bypasses().collect()}
    assert said == {0: ("[XIC(Run) , ]", False), 2: ("XIC(Start) AFI() OTE(Lamp)", False), 3: ("XIC(Cnt.0) … XIO(Cnt.0) in series", False), 4: ("[XIC(Stop) ,XIO(Stop) ]", False)}
    assert [g[:3] for g in got] == [("Area", 0, "empty-leg"), ("Area", 2, "afi"), ("Area", 3, "never-true"), ("Area", 4, "always-true")]
    assert got[0][3] == "Run" and got[2][3] == "Cnt.0"


def test_unconsumed_and_undefined(project):
    # the safety map reads Lamp
    assert sorted((r.operand, r.safety, r.kind) for r in project.unconsumed().collect()) == [("Always", False, None), ("Chain", True, None), ("Never", False, None)]
    assert sorted(r.base for r in project.undefined().collect()) == ["Always", "Never"]


def test_cross_reference_of_a_member(project):
    got = [(r.program, r.routine, r.place, r.is_write, r.instruction, r.operand) for r in project.xref("Zone1.Ok").collect()]
    assert got == [("Safe", "Main", "#0", True, "DEV", "Zone1.Ok"), ("Safe", "Main", "#1", False, None, None)]
    assert project.xref("Zone1.Fault").count() == 0
    got = [(r.place, r.is_write, r.txt) for r in project.xref("cnt", "Area").where("routine = 'Seq'").collect()]
    assert got == [("#L3", True, "    Cnt := 0;"), ("#L2", False, "IF Cnt > 5 THEN")]
    assert [r.data_type for r in project.lookup_tag("zone1", "Safe").collect()] == ["DEVT"] and project.lookup_tag("Start").count() == 0


def test_rung_lookup(project):
    assert [(r.at, r.txt, r.comment) for r in project.rung("Area", "Main", 0).collect()] == [(0, AREA[0], "first &")]
    assert [(r.at, r.hit) for r in project.rung("Area", "Seq", 1).collect()] == [(1, True), (2, False), (3, False), (4, False)]
    assert project.rung("AOI Dev", "Logic", 0).first().txt == "XIC(In)OTE(Obj.Ok);" and project.rung("Area", "Main", 9).count() == 0


def test_types_of_paths(project, spark):
    rows = [("Zone1", "DEVT"), ("Zone1.Ok", "DEVT"), ("Zone1.No", "DEVT"), ("DevInst[1,2].Obj.Fault", "Dev"), ("Cnt.3", "DINT"), ("Arr[4].Ok", "DEVT[10]")]
    p = project.elements.select("project").first().project
    df = spark.createDataFrame([(p, *r) for r in rows], "project string, operand string, type string")
    got = {r.operand: r.found for r in project.operand_types(df).collect()}
    assert got == {"Zone1": "DEVT", "Zone1.Ok": "BIT", "Zone1.No": None, "DevInst[1,2].Obj.Fault": "BIT", "Cnt.3": "BOOL", "Arr[4].Ok": "BIT"}


def test_safety(project):
    assert [(r.program) for r in project.safety_programs.collect()] == ["Safe"]
    assert [r.aoi for r in project.safety_instructions().collect()] == ["DEV"]
    # Zone1.Ok is written by the call; nothing writes the module's input, which isn't asked for
    assert project.unproduced().count() == 0
    (d,) = project.safety_devices().collect()
    assert (d.program, d.n, d.aoi, d.instance, [tuple(x) for x in d.inputs], d.objects[0].split("|")[-1]) == ("Safe", 0, "DEV", "DevInst", [("In", "Mod1:SI.Pt00")], "zone1")
    assert [(x.operand, x.consumers, x.sink, x.hops) for x in d.outputs] == [("Zone1.Ok", 1, "Mod1:SO.Pt00", 0)]
    assert project.orphan_devices().count() == 0 and project.coverage().count() == 0
    assert Project(project.elements, {"names": "(", "sinks": ["Chain", "["]}).setting_faults[0].startswith("names: ")


def test_validation(project, spark):
    assert sorted((r.kind, r.what, r.n) for r in project.issues().collect()) == [("tag", "Always", 4), ("tag", "Never", 3)]
    p = project.elements.select("project").first().project
    rungs = [(p, "Area", None, "Main", 0, "FOO(Start)OTE(Run)", None), (p, "Area", None, "Main", 1, "JSR(Nowhere)XIC(Dev2;", None), (p, "Area", None, "Main", 2, "Dev(DevInst,Start,Zone1);", None)]
    edited = spark.createDataFrame(rungs, "project string, program string, aoi string, routine string, n long, txt string, comment string")
    got = {(r.kind, r.what, r.n) for r in project.issues(edited, project.lines.where("program = 'none'")).collect()}
    assert got == {("structure", "rung must end with ;", 0), ("instruction", "FOO", 0), ("structure", "unbalanced ()", 1), ("call", "Nowhere", 1), ("tag", "Dev2;", 1)} or got == {("structure", "rung must end with ;", 0), ("instruction", "FOO", 0), ("structure", "unbalanced ()", 1), ("call", "Nowhere", 1), ("tag", "Dev2", 1)}


def test_call_tree_and_map(project):
    got = [(r.program, r.routine, r.level, r.recursive, r.missing) for r in project.call_tree().orderBy("program", "level").collect()]
    assert got == [("Area", "main", 0, False, False), ("Area", "seq", 1, False, False), ("Safe", "main", 0, False, False)]
    assert {(r.task, r.program): r.orphans for r in project.execution_map().collect()} == {("Cyc", "Area"): ["Old"], ("SafeT", "Safe"): []}


def test_files_round_trip(project):
    texts = {(r.program, r.aoi, r.routine): r.text for r in project.routine_files().collect()}
    assert texts[("Area", None, "Main")].startswith("// @program Area\n// @routine Main\n// @type RLL\n\n// ---- Rung 0 ----\n// > first &\nXIC(Start)")
    back = files.parse_routine(texts[("Area", None, "Main")])
    assert [t for t, _ in back["rungs"]] == AREA and back["rungs"][0][1] == "first &" and back["problems"] == []
    assert files.parse_routine(texts[("Area", None, "Seq")])["lines"] == SEQ
    xml = {r.routine: r.xml for r in project.import_files().where("program = 'Area'").collect()}
    again = l5x.elements_of("again", xml["Main"].encode())
    assert [r["text"] for r in again if r["element"] == "Text"] == AREA
    assert [r["text"] for r in l5x.elements_of("again", xml["Seq"].encode()) if r["element"] == "Line"] == [*SEQ, ""]
    lines = {r.line.split(",")[0]: r.line for r in project.tags_csv().collect()}
    assert lines["Run"] == "Run,BOOL,,,,1,1," and lines["Zone1"] == "Zone1,DEVT,,Safety,,1,1,"


def test_edits(project, spark):
    long = "[XIC(Aaaaaaaaaaaaaaaa.Bbbbbbbbbbbbbbbbbbbbbb.C) ,XIC(Dddddddddddddddddddd.Eeeeeeeeeeeeeeeeeeeeeeeee.F)]XIC(Gggggggggg)OTE(H);"
    head = {"program": "Area", "routine": "Main", "type": "RLL"}
    one = files.format_routine(head, [(0, long, "note"), (1, AREA[0], None)])
    flat = "\n".join(["// @routine Main", "// @type RLL", "", "// > note  ", long, AREA[0]])
    assert one.count("\n") > flat.count("\n") and files.content_hash(one) == files.content_hash(flat) != files.content_hash(one.replace("Stop", "Halt"))
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    manifest = spark.createDataFrame([(k, sha(one), files.content_hash(one)) for k in ("same", "laid", "edit", "gone", "lost")], "file string, hash string, content string")
    disk = spark.createDataFrame([("same", one), ("laid", flat), ("edit", one.replace("Stop", "Halt")), ("gone", one), ("lost", one.replace("Run", "Go"))], "file string, text string")
    now = spark.createDataFrame([(k, one) for k in ("same", "laid", "edit", "new")], "file string, text string")
    assert sorted(r.file for r in files.edited(disk, manifest).collect()) == ["edit", "lost"]
    assert {r.file: r.action for r in files.merged(manifest, now, disk).collect()} == {"same": "same", "laid": "heal", "edit": "keep", "gone": "remove", "lost": "orphan", "new": "write"}
    assert [r.file for r in files.changed_documents(now, disk).collect() if r.file != "new"] in (["laid", "edit"], ["edit", "laid"])
    p = project.elements.select("project").first().project
    rungs = spark.createDataFrame([(p, "Area", "Main", 0, AREA[0].replace(")", ") ")), (p, "Area", "Main", 1, "XIC( New )OTE(Run) ;")], "project string, program string, routine string, n long, txt string")
    got = files.with_original_text(rungs, project.rungs).orderBy("n").collect()
    assert [(r.txt, r.changed) for r in got] == [(AREA[0], False), ("XIC( New ) OTE(Run);", True)]
    many = spark.createDataFrame([("P", k) for k in range(25)], "project string, k int")
    assert files.implausible(many.limit(20), many).count() == 1 and files.implausible(many.limit(19), many).count() == 0


def aoi_project(name, usage, calls, logic=""):
    inner = f'<Routines><Routine Name="Logic" Type="RLL"><RLLContent>{rung_xml(0, logic)}</RLLContent></Routine></Routines>' if logic else ""
    more = f'<AddOnInstructionDefinition Name="Outer"><Parameters><Parameter Name="Obj" Usage="InOut" DataType="T" Required="true"/></Parameters><Routines><Routine Name="Logic" Type="RLL"><RLLContent>{rung_xml(0, "Dev(I,Obj.A,Obj.B);")}</RLLContent></Routine></Routines></AddOnInstructionDefinition>'
    return f"""<RSLogix5000Content TargetType="Controller"><Controller Name="{name}"><AddOnInstructionDefinitions><AddOnInstructionDefinition Name="Dev"><Parameters><Parameter Name="P" {usage} DataType="BOOL" Required="true"/><Parameter Name="Q" Usage="InOut" DataType="BOOL" Required="true"/></Parameters>{inner}</AddOnInstructionDefinition>{more}</AddOnInstructionDefinitions>
<Programs><Program Name="Main" MainRoutineName="R"><Routines><Routine Name="R" Type="RLL"><RLLContent>{"".join(rung_xml(n, t) for n, t in enumerate(calls))}</RLLContent></Routine><Routine Name="S" Type="ST"><STContent><Line Number="0"><![CDATA[Dev(I, X2, Y2); Fn(Z2);]]></Line></STContent></Routine><Routine Name="T" Type="ST"><STContent><Line Number="0"><![CDATA[JSR(S);]]></Line></STContent></Routine></Routines></Program></Programs></Controller></RSLogix5000Content>"""


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("two")
    (folder / "A.L5X").write_text(aoi_project("A", 'Usage="Input"', ["Dev(I,X,Y,Z);JSR(T);"], "XIC(P)OTE(Q.Done);"))
    (folder / "B.L5X").write_text(aoi_project("B", 'Usage="Output"', ["Dev(I,X,Y);Outer(J,W);OSR(S1,S2);"]))
    return Project(l5x.read_elements(spark, str(folder)).cache())


def test_projects_keep_their_own_signatures(two):
    got = {(r.project[-5:-4], r.routine, r.operand, r.is_write) for r in two.uses().where("base <> 'I' AND base <> 'J'").collect()}
    a = {("A", "R", "X", False), ("A", "R", "Y.Done", True), ("A", "R", "Z", False), ("A", "S", "X2", False), ("A", "S", "Y2.Done", True), ("A", "S", "Z2", False)}
    b = {("B", "R", "X", True), ("B", "R", "Y", True), ("B", "R", "Y", False), ("B", "R", "S1", True), ("B", "R", "S2", True), ("B", "S", "X2", True), ("B", "S", "Y2", True), ("B", "S", "Y2", False), ("B", "S", "Z2", False)}
    # the second pass sees what Dev does with what Outer passes on
    assert got == a | b | {("B", "R", "W.A", True), ("B", "R", "W.B", True), ("B", "R", "W.B", False)}


def test_text_calls_make_edges(two):
    assert {(r.project[-5:-4], r.src, r.dst) for r in two.call_edges().collect()} == {("A", "r", "t"), ("A", "t", "s"), ("B", "t", "s")}
    assert {(r.project[-5:-4], r.routine) for r in two.orphans().collect()} == {("B", "S"), ("B", "T")}


def test_one_shots_storage_alone_is_left_out(two):
    assert "S2" in {r.operand for r in two.unconsumed().collect()} and "S1" not in {r.operand for r in two.unconsumed().collect()}


def test_unused_definitions(two, project):
    assert two.unused().count() == 0
    assert project.unused().count() == 0


def test_other_roots_are_refused():
    with pytest.raises(ValueError):
        l5x.elements_of("x", b"<Other/>")


def test_file_stream_and_debounce(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "F1.L5X").write_text(PROJECT, encoding="utf-8")
    q = incremental.watch(spark, str(tmp_path / "in")).select("path", "length").writeStream.format("memory").queryName("seen_files").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("seen_files").count() == 1
    df = spark.sql("SELECT k, timestamp_millis(t) AS ts FROM VALUES ('a', 0), ('a', 300), ('a', 900), ('b', 100) AS v(k, t)")
    got = sorted((r.k, r.events) for r in incremental.debounced(df, "400 milliseconds", "k").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_pages(project):
    texts = {r.file: r.text for r in pages.documents(project).collect()}
    assert set(texts) == {"codebase.md", "map.md", "xref/controller.md", "xref/Area.md", "xref/Safe.md", "xref/AOI_Dev.md", "crossref.md", "instructions.md", "bypasses.md", "unconsumed.md", "safety.md", "tags.md", "types.md", "modules.md"}
    assert texts["map.md"].split("\n")[:5] == ["## Cyc (CONTINUOUS)", "### Area", "- main", "  - seq", "- never called: Old"]
    assert "## Zone1\n- write Safe/Main: #0 DEV.Obj Zone1.Ok\n- read Safe/Main: #1\n" in texts["xref/controller.md"]
    assert texts["modules.md"] == "- **Local**\n  - **Mod1** — **inhibited**\n"
    assert texts["unconsumed.md"].split("\n")[0] == "- Chain Safe/Main#1" and "- not scheduled: Spare" in texts["codebase.md"]
    assert texts["safety.md"].split("\n")[:4] == ["- device calls: 1", "- written, never read: 1", "Zone1.Ok | DEV | Mod1:SI.Pt00 | Safe/Main#0 | 1 | Mod1:SO.Pt00 |  | ", "- unread: Chain in 1 places by OTE"]
    assert "controller | Zone1 | DEVT | S | 1 | 1" in texts["tags.md"] and "DEVT.Ok : BIT" in texts["types.md"]
