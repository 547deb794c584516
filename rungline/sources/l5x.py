"""XML project files (L5X) as tables.

Each file is parsed in one pass by a streaming XML parser inside a task; a file is one task's work and files spread over the cluster. CDATA
is kept apart from the white space around it, so text keeps its indentation. Elements come out as rows with their attributes, the texts of
their leaf children and the names of the program, instruction definition and routine around them; the project's tables are selections."""

from __future__ import annotations

import xml.parsers.expat as expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = "project string, element string, seq int, parent int, attrs map<string,string>, texts map<string,string>, text string, program string, aoi string, routine string, ord int"
_MAP = pa.map_(pa.string(), pa.string())
_SCHEMA = pa.schema([("project", pa.string()), ("element", pa.string()), ("seq", pa.int32()), ("parent", pa.int32()), ("attrs", _MAP), ("texts", _MAP), ("text", pa.string()), ("program", pa.string()), ("aoi", pa.string()), ("routine", pa.string()), ("ord", pa.int32())])
_OWNERS = {"Program": "program", "AddOnInstructionDefinition": "aoi", "Routine": "routine"}
_LEAVES = ("Text", "Comment", "Description", "SafetyTagMap", "RevisionNote")


def elements_of(project: str, content: bytes | str, root: str = "RSLogix5000Content"):
    """Rows of one file; raises ValueError unless its root is `root`."""
    rows: list[dict] = []
    open_: list[dict] = []
    cdata = False

    def start(name, attrs):
        up = open_[-1] if open_ else None
        if up is None and name != root:
            raise ValueError(f"{project}: root is {name}")
        row = {"project": project, "element": name, "seq": len(rows) + 1, "parent": up["seq"] if up else 0, "attrs": attrs, "texts": {}, "ord": 0, "__plain": [], "__cdata": [], "__n": {}}
        for k in ("program", "aoi", "routine"):
            row[k] = up[k] if up else None
        if name in _OWNERS and not (name == "Program" and "ScheduledPrograms" == (up or {}).get("element")):
            row[_OWNERS[name]] = attrs.get("Name")
        if up is not None:
            row["ord"] = up["__n"].get(name, 0)
            up["__n"][name] = row["ord"] + 1
        rows.append(row)
        open_.append(row)

    def end(name):
        row = open_.pop()
        row["text"] = "".join(row["__cdata"]) if row["__cdata"] else "".join(row["__plain"])
        if name in _LEAVES and open_:
            open_[-1]["texts"][name] = row["text"].replace("\r\n", "\n").strip()

    def text(s):
        if open_:
            open_[-1]["__cdata" if cdata else "__plain"].append(s)

    def mark(on):
        def f():
            nonlocal cdata
            cdata = on
            if on and open_:
                open_[-1]["__cdata"].append("")

        return f

    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    p.StartCdataSectionHandler, p.EndCdataSectionHandler = mark(True), mark(False)
    p.Parse(content, True)
    return [{k: r[k] for k in _SCHEMA.names} for r in rows]


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """All elements of the L5X files at `path` (a file, folder or pattern). A project is named by its path."""
    return elements_in(spark.read.format("binaryFile").option("pathGlobFilter", "*.{L5X,l5x}").option("recursiveFileLookup", "true").load(path))


def elements_in(files: DataFrame) -> DataFrame:
    """read_elements of the rows (path, content) of files."""

    def parse(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = elements_of(name, content)
                for k in range(0, len(rows), 10_000):
                    part = [dict(r, attrs=list(r["attrs"].items()), texts=list(r["texts"].items())) for r in rows[k : k + 10_000]]
                    yield pa.RecordBatch.from_pylist(part, _SCHEMA)

    return files.select("path", "content").mapInArrow(parse, ELEMENTS)


def _attr(name: str):
    return F.col("attrs")[name]


def _sizes(name: str):
    """The sizes above 0 in an attribute, which commas or spaces part."""
    return F.transform(F.filter(F.split(F.trim(_attr(name)), r"[\s,]+"), lambda x: x.rlike("^[1-9][0-9]*$")), lambda x: x.cast("int"))


def rungs(e: DataFrame) -> DataFrame:
    """project, program, aoi, routine, n (renumbered from 0), txt, comment."""
    return e.where("element = 'Rung'").select("project", "program", "aoi", "routine", F.col("ord").cast("long").alias("n"), F.coalesce(F.col("texts")["Text"], F.lit("")).alias("txt"), F.col("texts")["Comment"].alias("comment"))


def st_lines(e: DataFrame) -> DataFrame:
    """project, program, aoi, routine, n, txt: the lines of Structured Text routines (not those of a chart's actions)."""
    body = e.where("element = 'STContent'").select("project", F.col("seq").alias("parent"), F.col("parent").alias("__up"))
    own = e.where("element = 'Routine'").select("project", F.col("seq").alias("__up"))
    lines = e.where("element = 'Line'").join(body, ["project", "parent"]).join(own, ["project", "__up"], "left_semi")
    return lines.select("project", "program", "aoi", "routine", F.col("ord").cast("long").alias("n"), F.replace(F.col("text"), F.lit("\r"), F.lit("")).alias("txt"))


def routines(e: DataFrame) -> DataFrame:
    kind = F.when(_attr("Type").isin("RLL", "ST", "FBD", "SFC"), _attr("Type")).otherwise("Unknown")
    plain = e.where("element = 'Routine'").select("project", "program", "aoi", _attr("Name").alias("routine"), kind.alias("type"), F.lit(None).cast("string").alias("undecoded"), F.col("texts")["Description"].alias("description"))
    locked = e.where("element = 'EncodedData' AND attrs['EncodedType'] = 'Routine'").select("project", "program", "aoi", _attr("Name").alias("routine"), F.lit("Unknown").alias("type"), F.lit("source protected").alias("undecoded"), F.lit(None).cast("string").alias("description"))
    return plain.unionByName(locked)


def tags(e: DataFrame) -> DataFrame:
    """project, scope ('' for the controller), name, data_type, dims, alias_for, safety, constant, access. Tags of a safety program are safety tags."""
    dims = _sizes("Dimensions")
    safe = programs(e).where("safety").select("project", F.col("program").alias("scope"), F.lit(True).alias("__s"))
    got = e.where("element = 'Tag'").select("project", F.coalesce("program", F.lit("")).alias("scope"), _attr("Name").alias("name"), _attr("DataType").alias("data_type"), dims.alias("dims"), _attr("AliasFor").alias("alias_for"), (_attr("Class") == "Safety").alias("safety"), (_attr("Constant") == "true").alias("constant"), _attr("ExternalAccess").alias("access"), F.col("texts")["Description"].alias("description"))
    return got.join(safe, ["project", "scope"], "left").withColumn("safety", F.coalesce("safety", F.lit(False)) | F.coalesce("__s", F.lit(False))).drop("__s")


def programs(e: DataFrame) -> DataFrame:
    return e.where("element = 'Program'").select("project", "program", _attr("MainRoutineName").alias("main_routine"), _attr("FaultRoutineName").alias("fault_routine"), F.coalesce(_attr("Disabled") == "true", F.lit(False)).alias("disabled"), F.coalesce(_attr("Class") == "Safety", F.lit(False)).alias("safety"))


def tasks(e: DataFrame) -> DataFrame:
    return e.where("element = 'Task'").select("project", "seq", _attr("Name").alias("task"), _attr("Type").alias("type"), _attr("Rate").cast("double").alias("rate_ms"), F.coalesce(_attr("Class") == "Safety", F.lit(False)).alias("safety"))


def task_programs(e: DataFrame) -> DataFrame:
    """project, task, ord, program in scheduled order."""
    lists = e.where("element = 'ScheduledPrograms'").select("project", F.col("seq").alias("__list"), F.col("parent").alias("seq"))
    named = e.where("element = 'ScheduledProgram'").select("project", F.col("parent").alias("__list"), "ord", _attr("Name").alias("program"))
    return named.join(lists, ["project", "__list"]).join(tasks(e).select("project", "seq", "task"), ["project", "seq"]).select("project", "task", "ord", "program")


def aoi_args(e: DataFrame) -> DataFrame:
    """project, aoi (upper case), ord from 1 in call order, param, usage: required and in-out parameters."""
    from pyspark.sql import Window

    p = e.where("element = 'Parameter' AND aoi IS NOT NULL").select("project", F.upper("aoi").alias("aoi"), "ord", _attr("Name").alias("param"), _attr("Usage").alias("usage"), ((_attr("Required") == "true") | (_attr("Usage") == "InOut")).alias("required"))
    return p.where("required AND lower(param) NOT IN ('enablein', 'enableout')").withColumn("ord", F.row_number().over(Window.partitionBy("project", "aoi").orderBy("ord"))).drop("required")


def aois(e: DataFrame) -> DataFrame:
    """project, name, safety, revision of user-defined instructions; encoded ones have no logic."""
    plain = e.where("element = 'AddOnInstructionDefinition'").select("project", _attr("Name").alias("name"), F.coalesce(_attr("Class") == "Safety", F.lit(False)).alias("safety"), _attr("Revision").alias("revision"), F.lit(False).alias("encoded"), F.col("texts")["Description"].alias("description"))
    locked = e.where("element = 'EncodedData' AND attrs['EncodedType'] = 'AddOnInstructionDefinition'").select("project", _attr("Name").alias("name"), F.coalesce(_attr("Class") == "Safety", F.lit(False)).alias("safety"), _attr("Revision").alias("revision"), F.lit(True).alias("encoded"), F.col("texts")["Description"].alias("description"))
    return plain.unionByName(locked)


def aoi_members(e: DataFrame) -> DataFrame:
    """project, aoi, name, data_type of parameters and local tags."""
    return e.where("element IN ('Parameter', 'LocalTag') AND aoi IS NOT NULL").select("project", "aoi", _attr("Name").alias("name"), _attr("DataType").alias("data_type"), (F.col("element") == "Parameter").alias("parameter"), _sizes("Dimensions").alias("dims"), F.col("texts")["Description"].alias("description"), _attr("Usage").alias("usage"), F.coalesce(_attr("Required") == "true", F.lit(False)).alias("required"))


def data_types(e: DataFrame) -> DataFrame:
    """project, name, kind: module types have a colon in their name, others are user-defined."""
    kind = F.when(_attr("Name").contains(":"), "module").otherwise("udt")
    return e.where("element = 'DataType'").select("project", _attr("Name").alias("name"), kind.alias("kind"))


def controllers(e: DataFrame) -> DataFrame:
    """project, controller, revision of the software (31.00 if the file doesn't say), partial: the file isn't a whole controller."""
    root = e.where("element = 'RSLogix5000Content'").select("project", _attr("SoftwareRevision").alias("r"), F.coalesce(_attr("TargetType") != "Controller", F.lit(False)).alias("partial"))
    major, minor = F.regexp_extract("r", r"(\d+)\.(\d+)", 1), F.regexp_extract("r", r"(\d+)\.(\d+)", 2)
    own = e.where("element = 'Controller'").select("project", _attr("Name").alias("controller"))
    return own.join(root, "project").select("project", "controller", F.when(major != "", F.concat_ws(".", major, F.lpad(minor, 2, "0"))).otherwise("31.00").alias("revision"), "partial")


def members(e: DataFrame) -> DataFrame:
    types = e.where("element = 'DataType'").select("project", F.col("seq").alias("t"), _attr("Name").alias("type_name"))
    lists = e.where("element = 'Members'").select("project", F.col("seq").alias("l"), F.col("parent").alias("t"))
    got = e.where("element = 'Member'").select("project", F.col("parent").alias("l"), "ord", _attr("Name").alias("name"), _attr("DataType").alias("data_type"), _attr("BitNumber").cast("int").alias("bit"), _attr("Target").alias("target"), _sizes("Dimension").alias("dims"), F.col("texts")["Description"].alias("description"))
    return got.join(lists, ["project", "l"]).join(types, ["project", "t"]).select("project", "type_name", "ord", "name", "data_type", "bit", "target", "dims", "description")


def modules(e: DataFrame) -> DataFrame:
    """project, module, parent, catalog, vendor, inhibited, revision, address (of the first upstream port), safety, description, ord.

    Safety: a network number other than 0 on anything but a controller, or marked as enabled."""
    lists = e.where("element = 'Ports'").select("project", F.col("seq").alias("__l"), F.col("parent").alias("seq"))
    up = e.where("element = 'Port' AND attrs['Upstream'] = 'true'").select("project", F.col("parent").alias("__l"), "ord", _attr("Address").alias("a"))
    up = up.join(lists, ["project", "__l"]).groupBy("project", "seq").agg(F.min_by("a", "ord").alias("address"))
    vendor = F.coalesce(_attr("UserDefinedVendor"), F.nullif(_attr("Vendor"), F.lit("")))
    network = F.regexp_replace(F.coalesce(_attr("SafetyNetwork"), F.lit("")), "^16#", "").rlike("(?i)[1-9a-f]")
    safe = (network & ~F.coalesce(_attr("ProductType") == "14", F.lit(False))) | F.coalesce(_attr("SafetyEnabled") == "true", F.lit(False))
    rows = e.where("element = 'Module'").join(up, ["project", "seq"], "left")
    return rows.select(
        "project", _attr("Name").alias("module"), F.when(_attr("ParentModule") != _attr("Name"), F.nullif(_attr("ParentModule"), F.lit(""))).alias("parent"), _attr("CatalogNumber").alias("catalog"),
        F.when(vendor.rlike(r"^\s*0*1\s*$"), "Allen-Bradley").otherwise(F.nullif(vendor, F.lit(""))).alias("vendor"), F.coalesce(_attr("Inhibited") == "true", F.lit(False)).alias("inhibited"),
        F.when(_attr("Major").isNotNull(), F.concat_ws(".", _attr("Major"), F.coalesce(_attr("Minor"), F.lit("0")))).alias("revision"), "address", safe.alias("safety"), F.col("texts")["Description"].alias("description"), F.col("ord").cast("long").alias("ord"),
    )


def safety_map(e: DataFrame) -> DataFrame:
    """project, standard, safety from the text `a=b, c=d`."""
    pair = F.explode(F.split(F.col("texts")["SafetyTagMap"], ","))
    return e.where("texts['SafetyTagMap'] <> ''").select("project", pair.alias("p")).select("project", F.trim(F.substring_index("p", "=", 1)).alias("standard"), F.trim(F.substring_index("p", "=", -1)).alias("safety")).where("standard <> '' AND safety <> ''")
