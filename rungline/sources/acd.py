"""Binary project files: the container, its record files, the object table, ladder text and comments as tables.

A file is read in one task; what comes out are rows, and everything that relates them (last record of an id, kinds by majority, rung order,
comments, names in texts) is joins and groupings. A damaged record is skipped to the next mark; a damaged directory raises ValueError."""

from __future__ import annotations

import gzip
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The container's directory entry (a name and two numbers), record marks, and where an object's fields stand.
_ENTRY, _NAME = 528, 520
_LIVE, _MARKS = 0xFAFA, (0xFAFA, 0xFEFE, 0xFDFD, 0xFBBF)
_BODY = 154
#: The collection that holds each kind of object, and the kind's code where a file has none.
COLLECTIONS = {"Task": ("RxTaskCollection", 0x12), "ProgramOrAoi": ("RxProgramCollection", 0x13), "Routine": ("RxRoutineCollection", 0x35), "Tag": ("RxTagCollection", 0x3E), "Module": ("RxMapDeviceCollection", 0xA4)}
#: Codes of routine types.
ROUTINE_TYPES = {1: "RLL", 2: "FBD", 3: "SFC", 4: "ST"}


def _u16(b, at: int) -> int:
    return struct.unpack_from("<H", b, at)[0]


def _u32(b, at: int) -> int:
    return struct.unpack_from("<I", b, at)[0]


def text16(b: bytes, start: int, stop: int) -> str:
    """UTF-16 text up to its first zero character."""
    part = bytes(b[start : min(stop, len(b))])
    part = part[: len(part) // 2 * 2].decode("utf-16-le", errors="replace")
    return part.split("\0", 1)[0]


def directory(raw: bytes) -> list[tuple[str, int, int]]:
    """(name, offset, length) of the files in a container; its directory stands at the end."""
    if len(raw) < 16:
        raise ValueError("too small for a project file")
    count = _u32(raw, len(raw) - 8)
    start = len(raw) - 8 - count * _ENTRY
    if not 0 < count <= 1000 or start < 0:
        raise ValueError("no directory at the end")
    out = []
    for at in range(start, len(raw) - 8, _ENTRY):
        name, length, offset = text16(raw, at, at + _NAME), _u32(raw, at + _NAME), _u32(raw, at + _NAME + 4)
        if not re.fullmatch(r"[\x20-\x7e]+", name):
            raise ValueError("an entry of the directory has no name")
        if offset + length > start:
            raise ValueError(f"{name} lies outside the file")
        out.append((name, offset, length))
    if "comps.dat" not in (n.lower() for n, _, _ in out):
        raise ValueError("no object table")
    return out


def unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)


def xml_text(data: bytes) -> str:
    return data[2 if data[:2] == b"\xff\xfe" else 0 :].decode("utf-16-le", errors="replace")


def _first(dat: bytes) -> int:
    """Where the first record stands: by two pointers of the head, else at the first live mark."""
    try:
        region = _u32(dat, 12)
        records = _u32(dat, region + 18) if _u16(dat, region) == 0xFEFE else -1
        if records >= 0 and _u16(dat, records) == 0xFEFE and 0 < (at := records + _u32(dat, records + 2)) < len(dat):
            return at
    except struct.error:
        pass
    at = dat.find(b"\xfa\xfa")
    return len(dat) if at < 0 else at


def dat_records(dat: bytes, every: bool = False):
    """(offset, mark, record) in order; live ones only unless `every`."""
    at = _first(dat)
    while at + 6 <= len(dat):
        mark, size = _u16(dat, at), _u32(dat, at + 2)
        if mark in _MARKS and size >= 6 and at + size <= len(dat):
            if every or mark == _LIVE:
                yield at, mark, dat[at : at + size]
            at += size
        elif (at := dat.find(b"\xfa\xfa", at + 1)) < 0:
            return


def _table(schema: str, rows):
    """A function of (project, content) batches that makes rows of a file's content."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for project, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [(project, *r) for r in rows(content)]
                for k in range(0, len(found), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[k : k + 5000], strict=True), arrow, strict=True)], schema=arrow)

    return run


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """project (the path), member (lower case), content (unpacked), size: the files in the containers at `path`."""
    return members_in(spark.read.format("binaryFile").option("pathGlobFilter", "*.{ACD,acd}").option("recursiveFileLookup", "true").load(path))


_MEMBERS = "project string, member string, content binary, size long"


def members_in(files: DataFrame) -> DataFrame:
    """read_members of the rows (path, content) of files."""
    return files.select("path", "content").mapInArrow(_table(_MEMBERS, lambda raw: [(n.lower(), data := unpacked(raw[o : o + k]), len(data)) for n, o, k in directory(raw)]), _MEMBERS)


def nested(members: DataFrame, member: str) -> DataFrame:
    """The files in a container that is itself a member, under the same project; one that can't be read has none."""

    def rows(raw):
        try:
            return [(n.lower(), data := unpacked(raw[o : o + k]), len(data)) for n, o, k in directory(raw)]
        except (ValueError, OSError):
            return []

    return _from(members, member, _MEMBERS.split(", ", 1)[1], rows)


def save_log(spark: SparkSession, path: str) -> DataFrame:
    """project, line, ord: dated lines of the log, or of the head of a container without one."""

    def lines(raw):
        log = next((raw[o : o + k] for n, o, k in directory(raw) if n.lower() == "version.log"), raw[:200_000])
        found = [x.strip() for x in log.decode("latin-1").splitlines()]
        return [(x, i) for i, x in enumerate(x for x in found if re.match(r"\d{4}-\d{2}-\d{2} ", x))]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ACD,acd}").option("recursiveFileLookup", "true").load(path)
    schema = "project string, line string, ord int"
    return files.select("path", "content").mapInArrow(_table(schema, lines), schema)


def _from(members: DataFrame, member: str, schema: str, rows) -> DataFrame:
    return members.where(F.col("member") == member).select("project", "content").mapInArrow(_table("project string, " + schema, rows), "project string, " + schema)


def records(members: DataFrame, member: str, every: bool = False) -> DataFrame:
    """project, offset, mark, record, declared: the records of a member file and how many its head declares."""
    return _from(members, member, "offset long, mark int, record binary, declared long", lambda d: [(at, mark, bytes(r), _u32(d, 20) if len(d) >= 24 else 0) for at, mark, r in dat_records(d, every)])


def attributes(body: bytes) -> dict[int, bytes]:
    """Attributes of an object's body; each one's own length counts, cut at the end."""
    out, at = {}, 82
    for _ in range(_u32(body, 78) if len(body) >= 82 else 0):
        if at + 8 > len(body):
            break
        size = _u32(body, at + 4)
        out[_u32(body, at)] = bytes(body[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def comps(members: DataFrame) -> DataFrame:
    """project, id, parent, name, kind, body, attrs, parent_key, member_key, schedule, type_code: the object table, the last record of each id."""

    def rows(dat):
        for at, _, r in dat_records(dat):
            if len(r) >= _BODY + 10:
                body = bytes(r[_BODY:])
                number = lambda need, i, read: read(body, i) if len(body) >= need else 0  # noqa: B023, E731
                yield at, _u32(r, 22), _u32(r, 26), text16(r, 30, _BODY), _u16(r, _BODY + 8), body, list(attributes(body).items()), number(14, 10, _u32), number(18, 14, _u32), number(14, 12, _u16), number(64, 62, _u16)

    names = ["id", "parent", "name", "kind", "body", "attrs", "parent_key", "member_key", "schedule", "type_code"]
    all_ = _from(members, "comps.dat", "at long, id long, parent long, name string, kind int, body binary, attrs map<long,binary>, parent_key long, member_key long, schedule int, type_code int", rows)
    return all_.groupBy("project", "id").agg(F.max_by(F.struct(*names[1:]), "at").alias("c")).select("project", "id", *[F.col(f"c.{n}").alias(n) for n in names[1:]])


def kinds(comps_: DataFrame) -> DataFrame:
    """project, what, kind: the code of each kind of object, the commonest among the children of its collections; ties go to the least id's."""
    what = F.create_map(*[F.lit(x) for w, (c, _) in COLLECTIONS.items() for x in (c, w)])
    parents = comps_.select("project", F.col("id").alias("parent"), what[F.col("name")].alias("what")).where("what IS NOT NULL")
    n = comps_.join(parents, ["project", "parent"]).groupBy("project", "what", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    found = n.groupBy("project", "what").agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("found"))
    usual = comps_.select("project").distinct().select("project", F.explode(F.create_map(*[F.lit(x) for w, (_, k) in COLLECTIONS.items() for x in (w, k)])).alias("what", "usual"))
    return usual.join(found, ["project", "what"], "left").select("project", "what", F.coalesce("found", "usual").alias("kind"))


def members_of(comps_: DataFrame, collection: str, what: str | None = None) -> DataFrame:
    """project, owner, and the objects in the owner's collection of that name, of its own kind or of the kind of `what`."""
    what = what or next(w for w, (c, _) in COLLECTIONS.items() if c == collection)
    lists = comps_.where(F.col("name") == collection).select("project", F.col("id").alias("parent"), F.col("parent").alias("owner"))
    return comps_.join(lists, ["project", "parent"]).join(kinds(comps_).where(F.col("what") == what).select("project", "kind"), ["project", "kind"], "left_semi")


def region_map(comps_: DataFrame) -> DataFrame:
    """project, owner, ord, region: the logic regions of each routine, from the longest region map."""

    def rows(body):
        stop = min(len(body), 0x4A + _u32(body, 0x4A)) if len(body) >= 0x4E else 0
        return [(_u32(body, at), _u32(body, at + 4), _u32(body, at + 12)) for at in range(0x4E, stop - 15, 16)]

    longest = comps_.where("name = 'Region Map' AND parent = 0").groupBy("project").agg(F.max_by("body", F.struct(F.length("body"), -F.col("id"))).alias("content"))
    schema = "project string, owner long, ord long, region long"
    return longest.select("project", "content").mapInArrow(_table(schema, rows), schema)


def rung_texts(members: DataFrame) -> DataFrame:
    """project, region, txt: ladder text with ids in place of names, the last of each region."""

    def rows(dat):
        for at, _, r in dat_records(dat):
            if len(r) >= 61 and bytes(r[16:24]) == b"Rung NT\0":
                part = bytes(r[61 : 61 + _u32(r, 57)])
                yield at, _u32(r, 12), part[: len(part) // 2 * 2].decode("utf-16-le", errors="replace").rstrip("\0")

    return _from(members, "sbregion.dat", "at long, region long, txt string", rows).groupBy("project", "region").agg(F.max_by("txt", "at").alias("txt"))


def comment_links(members: DataFrame) -> DataFrame:
    """project, region, key: the comment key of a region, the last slot of each. Slots have 22 bytes and are told by their pattern."""
    slot = re.compile(rb"(?<=\0\0)\x02[\0\x01]\0\x01(.{4}).{4}(.{4}).{2}", re.DOTALL)

    def rows(dat):
        at = 2
        while m := slot.search(dat, at):
            yield m.start(), struct.unpack("<I", m[2])[0], struct.unpack("<I", m[1])[0] & 0xFFFF
            at = m.start() + 22

    return _from(members, "regnlink.dat", "at long, region long, key long", rows).groupBy("project", "region").agg(F.max_by("key", "at").alias("key"))


def comments(members: DataFrame) -> DataFrame:
    """project, parent_key, member_key, rung_key (null for an object's own description), text: the last of each key."""

    def rows(dat):
        for at, _, r in dat_records(dat):
            if len(r) >= 51 and _u16(r, 12) == 1:
                text = bytes(r[50:]).split(b"\0", 1)[0].decode("utf-8", errors="replace").replace("\r\n", "\n").rstrip()
                if text:
                    key = _u32(r, 24)
                    yield at, _u32(r, 16), _u32(r, 20), key >> 16 if key else None, text

    by = ["project", "parent_key", "member_key", "rung_key"]
    return _from(members, "comments.dat", "at long, parent_key long, member_key long, rung_key long, text string", rows).groupBy(*by).agg(F.max_by("text", "at").alias("text"))


def resolved(units: DataFrame, comps_: DataFrame, keys: list[str], text: str = "txt") -> DataFrame:
    """units with the ids in `text` replaced by names: first @id@, then the modules' &id:. `unresolved` counts the ids that no object has."""
    names = comps_.select("project", F.col("id").alias("__id"), F.col("name").alias("__name"))
    at = units
    for k, (pattern, before, after) in enumerate(((r"@([0-9a-fA-F]{8})@", "@", "@"), (r"&([0-9a-fA-F]{8}):", "&", ":"))):
        ids = at.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("__hex")).withColumn("__id", F.conv("__hex", 16, 10).cast("long"))
        swap = F.struct(F.concat(F.lit(before), "__hex", F.lit(after)).alias("was"), F.concat("__name", F.lit("" if k == 0 else after)).alias("now"))
        swaps = ids.join(names, ["project", "__id"]).groupBy(*keys).agg(F.collect_list(swap).alias("__swaps"))
        at = at.join(swaps, keys, "left").withColumn(text, F.when(F.col("__swaps").isNull(), F.col(text)).otherwise(F.aggregate("__swaps", F.col(text), lambda t, s: F.replace(t, s["was"], s["now"])))).drop("__swaps")
    return at.withColumn("unresolved", F.regexp_count(text, F.lit(r"@[0-9a-fA-F]{8}@|&[0-9a-fA-F]{8}:")))


def routines(comps_: DataFrame) -> DataFrame:
    """project, program, aoi, routine, id, type, parent_key, member_key: the routines of programs and user-defined instructions."""
    inside = F.col("name") == "RxProgramCollection"
    lists = comps_.where(inside | (F.col("name") == "RxUDIDefinitionCollection")).select("project", F.col("id").alias("__list"), inside.alias("__program"))
    own = comps_.select("project", F.col("id").alias("owner"), F.col("name").alias("__name"), F.col("parent").alias("__list")).join(lists, ["project", "__list"])
    own = own.select("project", "owner", F.when(F.col("__program"), F.col("__name")).alias("program"), F.when(~F.col("__program"), F.col("__name")).alias("aoi"))
    kind = F.create_map(*[F.lit(x) for p in ROUTINE_TYPES.items() for x in p])[F.col("type_code")]
    return members_of(comps_, "RxRoutineCollection").join(own, ["project", "owner"]).select("project", "program", "aoi", F.col("name").alias("routine"), "id", F.coalesce(kind, F.lit("Unknown")).alias("type"), "parent_key", "member_key")


def rungs(members: DataFrame, comps_: DataFrame) -> DataFrame:
    """project, program, aoi, routine, n, txt, comment, unresolved: ladder logic in region order; a region without text is an empty rung.

    What is parsed from `members` here is as large as the logic, whatever size Spark guesses, so none of it is broadcast."""
    own = routines(comps_).where("type IN ('RLL', 'Unknown')").withColumnRenamed("id", "owner")
    at = region_map(comps_).join(own, ["project", "owner"]).join(rung_texts(members).hint("merge"), ["project", "region"], "left").join(comment_links(members).hint("merge"), ["project", "region"], "left")
    said = comments(members).where("rung_key IS NOT NULL").select("project", "parent_key", "member_key", F.col("rung_key").alias("key"), F.col("text").alias("comment"))
    at = at.join(said.hint("merge"), ["project", "parent_key", "member_key", "key"], "left")
    n = F.row_number().over(Window.partitionBy("project", "owner").orderBy("ord", "region")) - 1
    rows = at.select("project", "owner", "program", "aoi", "routine", n.cast("long").alias("n"), F.coalesce("txt", F.lit("")).alias("txt"), "comment")
    return resolved(rows, comps_, ["project", "owner", "n"]).drop("owner")
