"""Edited routine files of export folders as import files, with what is wrong with each and a report a folder.

The folder is all that is needed: the manifest says whose file each is, the tables beside it what the project has. Edited files are parsed
once; everything else is joins of their units with the project's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from . import folder, routines

ROUTINE = ["project", "program", "routine"]
REPORT, PLACE = "edits/IMPORT_REPORT.md", "edits/"
#: Why a file isn't packed.
OF_INSTRUCTION = "logic of a user-defined instruction can't be imported as a routine: edit the instruction's definition"
NOT_READ = "the routine wasn't decoded, so it can't be built again"
_SAID = {"structure": "", "instruction": "unknown instruction ", "call": "no such routine in the program: ", "tag": "declared nowhere: "}


@dataclass
class Imports:
    """edits: file, project, program, aoi, routine, type, skipped, target (the import file, null if skipped), before, after, changed (units; null
    if skipped), issues (array of struct n, what). xml: file, text. report: file, text."""

    edits: DataFrame
    xml: DataFrame
    report: DataFrame


def prepared(p, there: DataFrame, manifest: DataFrame) -> Imports:
    """p: the project tables as exported (folder.read_model); there: folder.read_files; manifest: folder.read_manifest.

    A unit whose logic is unchanged keeps the project's own text. A name in a file's head that isn't its routine's is reported, and the
    routine's counts. Of each edited file there is one row, whether it can be packed or not."""
    own = manifest.where("routine IS NOT NULL").withColumnRenamed("source", "project")
    skipped = F.when(F.col("aoi").isNotNull(), OF_INSTRUCTION).when(~F.coalesce("editable", F.lit(False)), NOT_READ)
    e = routines.edited(there, own).join(own.select("file", *ROUTINE, "aoi", "type", "editable"), "file")
    e = graph.kept(e.select("file", *ROUTINE, "aoi", "type", skipped.alias("skipped"), routines.parsed_file("text").alias("f")))
    ok = e.where("skipped IS NULL")
    no = F.lit(None).cast("string")
    unit = lambda what: ok.select(*ROUTINE, F.posexplode(what).alias("n", "u")).withColumns({"aoi": no, "n": F.col("n").cast("long")})
    rungs = unit("f.rungs").select("project", "program", "aoi", "routine", "n", F.col("u.text").alias("txt"), F.col("u.comment").alias("comment"))
    lines = unit("f.lines").select("project", "program", "aoi", "routine", "n", F.col("u").alias("txt"))
    mine = ok.select(*ROUTINE).distinct()
    was_rungs, was_lines = (t.where("program IS NOT NULL").join(mine, ROUTINE, "left_semi") for t in (p.rungs, p.lines))
    rungs = graph.kept(routines.with_original_text(rungs, was_rungs))

    fresh = lines.join(was_lines.select(*ROUTINE, "txt").distinct(), [*ROUTINE, "txt"], "left_anti")
    n = lambda df, name: df.groupBy(*ROUTINE).agg(F.count("*").alias(name))
    counts = mine
    for df in (n(was_rungs.unionByName(was_lines, allowMissingColumns=True), "before"), n(rungs.select(*ROUTINE).unionByName(lines.select(*ROUTINE)), "after"), n(rungs.where("changed").select(*ROUTINE).unionByName(fresh.select(*ROUTINE)), "changed")):
        counts = counts.join(df, ROUTINE, "left")
    counts = counts.na.fill(0)

    said = F.lit(None).cast("string")
    for kind, words in _SAID.items():
        said = F.when(F.col("kind") == kind, F.concat(F.lit(words), "what")).otherwise(said)
    found = p.issues(rungs.select("project", "program", "aoi", "routine", "n", "txt", "comment"), lines).select(*ROUTINE, F.col("n").alias("at"), said.alias("what"))
    found = ok.select("file", *ROUTINE).join(found, ROUTINE).select("file", F.lit(1).alias("o"), F.col("at"), "what")
    none = F.lit(None).cast("long")
    shape = e.select("file", F.lit(0).alias("o"), none.alias("at"), F.explode("f.problems").alias("what"))
    head = F.concat(F.lit("the head names "), "f.routine", F.lit(", but the file is of "), "routine", F.lit(", which counts"))
    other = ok.where("f.routine <> routine").select("file", F.lit(0).alias("o"), none.alias("at"), head.alias("what"))
    issues = found.unionByName(shape).unionByName(other).groupBy("file").agg(F.array_sort(F.collect_set(F.struct("o", "at", "what"))).alias("i"))
    issues = issues.select("file", F.transform("i", lambda x: F.struct(x["at"].alias("n"), x["what"].alias("what"))).alias("issues"))

    target = F.when(F.col("skipped").isNull(), F.concat(F.substring_index("file", "/", 1), F.lit(f"/{PLACE}"), folder.safe_name(F.coalesce("program", F.lit("_"))), F.lit("__"), folder.safe_name("routine"), F.lit(".L5X")))
    edits = e.join(counts, ROUTINE, "left").join(issues, "file", "left").withColumn("target", target)
    empty = F.array().cast("array<struct<n:bigint,what:string>>")
    edits = graph.kept(edits.select("file", *ROUTINE, "aoi", "type", "skipped", "target", *[F.when(F.col("skipped").isNull(), F.col(c)).alias(c) for c in ("before", "after", "changed")], F.coalesce("issues", empty).alias("issues")))

    heads = ok.select(*ROUTINE, "aoi", "type", F.col("f.description").alias("description")).join(p.controllers.select("project", "controller"), "project", "left")
    units = rungs.select(*ROUTINE, "n", "txt", "comment").unionByName(lines.select(*ROUTINE, "n", "txt", no.alias("comment")))
    xml = routines.import_files(heads, units).join(edits.select(*ROUTINE, F.col("target").alias("file")), ROUTINE).select("file", F.col("xml").alias("text"))
    return Imports(edits, xml, report(edits, manifest))


def report(edits: DataFrame, manifest: DataFrame) -> DataFrame:
    """file, text: a report for each project folder of the manifest, also where nothing was edited. A folder's lines are one file."""
    line = lambda df, part, text: df.select("file", F.col("file").alias("by"), F.lit(part).alias("part"), F.lit(0).alias("k"), text.alias("line"))
    noun = F.when(F.col("type") == "ST", "Lines").otherwise("Rungs")
    parts = line(edits, 0, F.concat(F.lit("\n## "), F.coalesce("program", F.concat(F.lit("AOI "), "aoi"), F.lit("")), F.lit("/"), "routine", F.lit("\n")))
    parts = parts.unionByName(line(edits, 1, F.concat(F.lit("- Source: `"), "file", F.lit("`"))))
    parts = parts.unionByName(line(edits, 2, F.when(F.col("target").isNull(), F.concat(F.lit("- **Not packed:** "), "skipped")).otherwise(F.concat(F.lit("- Import file: `"), "target", F.lit("`")))))
    parts = parts.unionByName(line(edits.where("target IS NOT NULL"), 3, F.concat(F.lit("- "), noun, F.lit(": "), F.col("before").cast("string"), F.lit(" → "), F.col("after").cast("string"), F.lit(" ("), F.col("changed").cast("string"), F.lit(" new or changed)"))))
    parts = parts.unionByName(line(edits, 4, F.when(F.size("issues") > 0, "- Issues:").otherwise("- No issues found.")))
    each = edits.select("file", F.col("file").alias("by"), "type", F.posexplode("issues").alias("k", "i"))
    at = F.when(F.col("i.n").isNull(), "").when(F.col("type") == "ST", F.concat(F.lit("line "), (F.col("i.n") + 1).cast("string"), F.lit(": "))).otherwise(F.concat(F.lit("rung "), F.col("i.n").cast("string"), F.lit(": ")))
    parts = parts.unionByName(each.select("file", "by", F.lit(5).alias("part"), "k", F.concat(F.lit("  - "), at, "i.what").alias("line")))
    gathered = parts.groupBy(F.substring_index("file", "/", 1).alias("folder")).agg(F.array_sort(F.collect_list(F.struct("by", "part", "k", "line"))).alias("l"))
    top = manifest.groupBy("folder").agg(F.first("source").alias("source")).join(gathered, "folder", "left")
    body = F.when(F.col("l").isNull(), "\nNo edited routines.").otherwise(F.array_join("l.line", "\n"))
    return top.select(F.concat("folder", F.lit(f"/{REPORT}")).alias("file"), F.concat(F.lit("# Imports of "), "source", F.lit("\n"), body, F.lit("\n")).alias("text"))


def package(spark: SparkSession, path: str, settings: dict | None = None) -> DataFrame:
    """Write the import files and reports of all folders below `path`; returns Imports.edits. Import files of an earlier run that no edit
    makes any more go."""
    there = graph.kept(folder.read_files(spark, path))
    manifest = graph.kept(folder.read_manifest(there))
    made = prepared(folder.read_model(spark, path, settings), there, manifest)
    now = made.xml.unionByName(made.report)
    old = there.where(F.col("file").rlike(f"^[^/]+/{PLACE}[^/]+$")).select("file", F.col("text").alias("old"))
    todo = graph.kept(now.join(old, "file", "full_outer").withColumn("action", F.when(F.col("text").isNull(), "remove").when(F.col("text").eqNullSafe(F.col("old")), "same").otherwise("write")))
    folder._write(todo.where("action <> 'same'"), path)
    return made.edits
