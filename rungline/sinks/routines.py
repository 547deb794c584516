"""Routine files: writing them, reading edited ones back, telling edits from mere layout, and packing edits for import."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions import rung

#: How a routine file marks its head, rungs and comments.
_HEAD = re.compile(r"\s*//\s*@(\w+)\s?(.*)$")
_COMMENT = re.compile(r"\s*//\s?>\s?(.*)$")
_MARKER = "// ---- Rung {0} ----"
_KEYS = ("aoi", "program", "routine", "type")
OWNER = ["project", "program", "aoi", "routine"]


def format_routine(head: dict, units: list[tuple]) -> str:
    """The text of a routine file. units: (n, text, comment) of rungs, or of lines (whose comment is None), in order."""
    out = [f"// @{k} {head[k]}" for k in _KEYS if head.get(k)]
    out += [f"// @description {x}" for x in (head.get("description") or "").split("\n")] if head.get("description") else []
    out += [f"// @undecoded {head['undecoded']}"] if head.get("undecoded") else []
    if head.get("type") == "RLL":
        for n, text, comment in units:
            out += ["", _MARKER.format(n)]
            out += [f"// > {x}".rstrip(" ") if not x else f"// > {x}" for x in comment.split("\n")] if comment else []
            out += rung.layout(text).split("\n") if text else ["// (rung text not stored in the project file)"]
    elif units:
        out += ["", *[text for _, text, _ in units]]
    return "\n".join([*out, ""])


def parse_routine(text: str) -> dict:
    """head (program, aoi, routine, type, description, undecoded), rungs [(text, comment)], lines, problems of a routine file."""
    rows, at = text.replace("\r\n", "\n").split("\n"), 0
    head, said, faults = {"type": "RLL", "routine": ""}, [], []
    while at < len(rows):
        m = _HEAD.match(rows[at])
        if rows[at].strip() == "":
            if head["routine"]:
                break
        elif not m:
            break
        elif (key := m[1].lower()) == "description":
            said.append(m[2])
        elif key in _KEYS:
            head[key] = m[2].strip().upper() if key == "type" else m[2].strip()
        elif key == "undecoded":
            head[key] = m[2]
        at += 1
    head["description"] = "\n".join(said) if said else None
    if not head["routine"]:
        faults.append("no routine is named in the head")
    body = rows[at:]
    if head["type"] != "RLL":
        there = [k for k, x in enumerate(body) if x.strip()]
        return {"head": head, "rungs": [], "lines": body[there[0] : there[-1] + 1] if there else [], "problems": faults}
    rungs, comment, part = [], [], []
    for k, row in enumerate(body, at + 1):
        if m := _COMMENT.match(row):
            if part:
                faults.append(f"line {k}: a comment inside an open rung")
            comment.append(m[1])
        elif row.strip() and not row.strip().startswith("//"):
            part.append(row.strip())
            if part[-1].endswith(";"):
                rungs.append((" ".join(part), "\n".join(comment) if comment else None))
                comment, part = [], []
    if part:
        faults.append(f"the last rung has no closing ;: {' '.join(part)[:80]}")
    return {"head": head, "rungs": rungs, "lines": [], "problems": faults}


def content_hash(text: str) -> str:
    """A hash of what a routine file says, whatever its layout: name, type, description, canonical rungs with comments, lines."""
    f = parse_routine(text)
    trim = lambda s: "\n".join(x.rstrip() for x in (s or "").split("\n")).strip()
    said = [f["head"]["routine"], f["head"]["type"], trim(f["head"]["description"]), [[rung.canonical(t), trim(c)] for t, c in f["rungs"]], [x.rstrip() for x in f["lines"]]]
    return hashlib.sha1(json.dumps(said, ensure_ascii=False).encode()).hexdigest()


def _scalar(fn, kind: pa.DataType):
    @F.arrow_udf(from_arrow_type(kind))
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fn(t) for t in text.to_pylist()], kind)

    return run


_S = pa.string()
PARSED = pa.struct([("program", _S), ("aoi", _S), ("routine", _S), ("type", _S), ("description", _S), ("rungs", pa.list_(pa.struct([("text", _S), ("comment", _S)]))), ("lines", pa.list_(_S)), ("problems", pa.list_(_S))])


def _row(text: str) -> dict:
    f = parse_routine(text)
    return {k: f["head"].get(k) for k in ("program", "aoi", "routine", "type", "description")} | {"rungs": [{"text": t, "comment": c} for t, c in f["rungs"]], "lines": f["lines"], "problems": f["problems"]}


parsed_file = _scalar(_row, PARSED)
content_hash_of = _scalar(content_hash, _S)


def routine_files(routines: DataFrame, units: DataFrame) -> DataFrame:
    """project, program, aoi, routine, type, text: a file for each routine. units: OWNER, n, txt, comment.

    A routine's units meet in one group, as they are lines of one file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.astype(object).where(pdf.notna(), None).sort_values("n", na_position="first")
        first = pdf.iloc[0]
        own = [(int(r.n), r.txt, r.comment) for r in pdf.itertuples() if r.n is not None]
        return pd.DataFrame([[*(first[k] for k in (*OWNER, "type")), format_routine({k: first[k] for k in (*_KEYS, "description", "undecoded")}, own)]], columns=[*OWNER, "type", "text"])

    same = lambda k: F.col(f"r.{k}").eqNullSafe(F.col(f"u.{k}"))
    both = routines.alias("r").join(units.alias("u"), same("project") & same("program") & same("aoi") & same("routine"), "left")
    columns = [F.col(f"r.{k}").alias(k) for k in (*OWNER, "type", "description", "undecoded")]
    rows = both.select(*columns, F.col("u.n").alias("n"), F.col("u.txt").alias("txt"), F.col("u.comment").alias("comment"))
    return rows.groupBy(*OWNER).applyInPandas(run, "project string, program string, aoi string, routine string, type string, text string")


def edited(files: DataFrame, manifest: DataFrame, key: str = "file") -> DataFrame:
    """The rows of files(key, text) that were edited since manifest(key, hash, content): both the raw hash and the content's hash differ.

    Only files whose raw hash differs are parsed."""
    both = files.join(manifest.select(key, F.col("hash").alias("__hash"), F.col("content").alias("__content")), key)
    changed = both.where(F.sha1(F.col("text").cast("binary")) != F.col("__hash"))
    return changed.where(F.col("__content").isNull() | (content_hash_of("text") != F.col("__content"))).select(*files.columns)


def merged(previous: DataFrame, current: DataFrame, on_disk: DataFrame, key: str = "file") -> DataFrame:
    """key, action, text for a new export: write (new, or the project changed it), keep (edited by hand), same (nothing to write), heal (only
    the layout differs from what was exported), remove (vanished) or orphan (vanished but edited).

    previous(key, hash, content): the manifest; current(key, text): what the project says now; on_disk(key, text)."""
    touched = edited(on_disk, previous, key).select(key, F.lit(True).alias("edited"))
    p, c, d = previous.select(key, F.lit(True).alias("was")), current.select(key, F.col("text").alias("now")), on_disk.select(key, F.col("text").alias("there"))
    rows = c.join(d, key, "full_outer").join(p, key, "left").join(touched, key, "left")
    own = F.coalesce("edited", F.lit(False))
    action = (
        F.when(F.col("now").isNull(), F.when(own, "orphan").when(F.col("was"), "remove").otherwise("keep"))
        .when(F.col("there").isNull(), "write").when(F.col("now") == F.col("there"), "same").when(own & (content_hash_of("now") != content_hash_of("there")), "keep")
        .when(content_hash_of("now") == content_hash_of("there"), "heal").otherwise("write")
    )
    return rows.select(key, action.alias("action"), F.when(action.isin("write", "heal"), F.col("now")).otherwise(F.col("there")).alias("text"))


def implausible(edits: DataFrame, all_files: DataFrame) -> DataFrame:
    """project, edited, files: so many edits that they are unlikely to be by hand: 20 at least, and a quarter of the files."""
    n = all_files.groupBy("project").agg(F.count("*").alias("files")).join(edits.groupBy("project").agg(F.count("*").alias("edited")), "project")
    return n.where("edited >= 20 AND 4 * edited >= files").select("project", "edited", "files")


def with_original_text(edited_rungs: DataFrame, original: DataFrame) -> DataFrame:
    """edited_rungs(OWNER, n, txt, comment) with the project's own text where only the layout differs, the canonical text elsewhere; and `changed`."""
    canon = lambda df: df.withColumn("__canon", rung.canonical_rung("txt"))
    own = canon(original).groupBy("project", "program", "routine", "__canon").agg(F.max_by("txt", "n").alias("__own"))
    both = canon(edited_rungs).join(own, ["project", "program", "routine", "__canon"], "left")
    return both.withColumn("changed", F.col("__own").isNull()).withColumn("txt", F.coalesce("__own", "__canon")).drop("__own", "__canon")


def _attr(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def _cdata(c):
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


#: Fixed value: the options that an importer expects.
EXPORT_OPTIONS = "References NoRawData L5KData DecoratedData Context RoutineLabels AliasReferences IOTags NoStringData ForceProtectedEncoding AllProjDocTrans"
_NL = "\r\n"


def import_files(routines: DataFrame, units: DataFrame, revision: str = "31.00", date: str | None = None) -> DataFrame:
    """project, program, routine, xml: an import file for each routine, made of column expressions. routines: OWNER, type, description."""
    crlf = lambda c: F.replace(c, F.lit("\n"), F.lit(_NL))
    number = (F.row_number().over(_window()) - 1).cast("string")
    u = units.where("program IS NOT NULL").withColumn("__i", number)
    comment = F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(f"<Comment>{_NL}"), _cdata(crlf(F.col("comment"))), F.lit(f"{_NL}</Comment>{_NL}"))).otherwise("")
    as_rung = F.concat(F.lit('<Rung Number="'), "__i", F.lit(f'" Type="N">{_NL}'), comment, F.lit(f"<Text>{_NL}"), _cdata(F.col("txt")), F.lit(f"{_NL}</Text>{_NL}</Rung>"))
    as_line = F.concat(F.lit('<Line Number="'), "__i", F.lit(f'">{_NL}'), _cdata(F.col("txt")), F.lit(f"{_NL}</Line>"))
    parts = u.groupBy("project", "program", "routine").agg(F.array_sort(F.collect_list(F.struct(F.col("n"), as_rung.alias("rung"), as_line.alias("line")))).alias("__u"))
    rows = routines.where("program IS NOT NULL AND type IN ('RLL', 'ST')").join(parts, ["project", "program", "routine"], "left")
    inside = F.when(F.col("type") == "RLL", F.array_join("__u.rung", _NL)).otherwise(F.array_join("__u.line", _NL))
    body = F.when(F.col("__u").isNull(), "").otherwise(F.concat(inside, F.lit(_NL)))
    content = F.when(F.col("type") == "RLL", "RLLContent").otherwise("STContent")
    day = F.lit(date) if date else F.date_format(F.current_timestamp(), "EEE MMM dd HH:mm:ss yyyy")
    described = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(f"<Description>{_NL}"), _cdata(crlf(F.col("description"))), F.lit(f"{_NL}</Description>{_NL}"))).otherwise("")
    xml = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{_NL}<RSLogix5000Content SchemaRevision="1.0" SoftwareRevision="{revision}" TargetName="'), _attr(F.col("routine")),
        F.lit('" TargetType="Routine" TargetSubType="'), "type", F.lit('" ContainsContext="true" ExportDate="'), day, F.lit(f'" ExportOptions="{EXPORT_OPTIONS}">{_NL}<Controller Use="Context" Name="'),
        _attr(F.coalesce("controller", F.lit(""))), F.lit(f'">{_NL}<Programs Use="Context">{_NL}<Program Use="Context" Name="'), _attr(F.col("program")), F.lit(f'">{_NL}<Routines Use="Context">{_NL}<Routine Use="Target" Name="'),
        _attr(F.col("routine")), F.lit('" Type="'), "type", F.lit(f'">{_NL}'), described, F.lit("<"), content, F.lit(f">{_NL}"), body, F.lit("</"), content,
        F.lit(f">{_NL}</Routine>{_NL}</Routines>{_NL}</Program>{_NL}</Programs>{_NL}</Controller>{_NL}</RSLogix5000Content>{_NL}"),
    )
    return rows.select("project", "program", "routine", xml.alias("xml"))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("project", "program", "routine").orderBy("n")


def csv_cell(c):
    """A text as a CSV cell, quoted where it must be."""
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def tags_csv(tags: DataFrame, counts: DataFrame) -> DataFrame:
    """project, scope, line: tags as CSV lines with how often each is read and written. counts: project, scope, name (lower case), reads, writes."""
    t = tags.withColumn("__name", F.lower("name")).join(counts.select("project", "scope", F.col("name").alias("__name"), "reads", "writes"), ["project", "scope", "__name"], "left")
    dims = F.when(F.size("dims") > 0, F.concat(F.lit("["), F.array_join(F.transform("dims", lambda d: d.cast("string")), ","), F.lit("]"))).otherwise("")
    cells = [F.col("name"), F.concat(F.coalesce("data_type", F.lit("")), dims), F.col("alias_for"), F.when(F.col("safety"), "Safety"), F.col("access"), F.coalesce("reads", F.lit(0)).cast("string"), F.coalesce("writes", F.lit(0)).cast("string"), F.col("description")]
    return t.select("project", "scope", F.concat_ws(",", *[csv_cell(F.coalesce(c, F.lit(""))) for c in cells]).alias("line"))


def changed_documents(documents: DataFrame, there: DataFrame, key: str = "file") -> DataFrame:
    """The documents(key, text) whose hash isn't that of there(key, text): an idempotent sink writes these alone."""
    h = lambda df: df.select(key, F.sha1(F.col("text").cast("binary")).alias("__h"))
    new = h(documents).join(h(there), [key, "__h"], "left_anti").select(key)
    return documents.join(new, key, "left_semi")
