"""Programs, tasks, tags, instruction parameters and modules of a binary project, from its object table.

Objects' attributes are byte strings that column expressions read; what refers to what is joins by id. Nothing here runs Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from . import acd

#: Where attribute 1 of each kind of object keeps what, and the value that marks safety.
_SAFETY = 6
_PROGRAM_DISABLED, _PROGRAM_CLASS, _MAIN, _FAULT = 0x24, 139, 0x12D, 0x66
_AOI_MAJOR, _AOI_MINOR, _AOI_CLASS = 26, 28, 134
_TAG_FLAGS, _TAG_ACCESS, _TAG_CONSTANT, _TAG_CLASS, _CONNECTION = 526, 542, 543, 589, 0x6B
_TASK_CLASS, _TASK_TYPES = 4316, {1: "EVENT", 2: "PERIODIC", 4: "CONTINUOUS"}
#: The two places of a task's rate, type, priority and watchdog.
_LAYOUTS = ((4114, 4252, 4254, 4272), (514, 652, 654, 802))


def attribute(number: int) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(number).cast("long"))


def number(data: Column, at: int, width: int) -> Column:
    """A little-endian number, null where the data are too short."""
    total = F.lit(0).cast("long")
    for k in range(width):
        total = total + F.conv(F.hex(F.substring(data, at + k + 1, 1)), 16, 10).cast("long") * (1 << (8 * k))
    return F.when(F.length(data) >= at + width, total)


def _bit(value: Column, mask: int) -> Column:
    return F.coalesce(value.bitwiseAND(F.lit(mask).cast("long")) != 0, F.lit(False))


def _named(df: DataFrame, comps: DataFrame, key: str, name: str) -> DataFrame:
    """df with the name of the object whose id is in `key`."""
    return df.join(comps.select("project", F.col("id").alias(key), F.col("name").alias(name)), ["project", key], "left").drop(key)


def programs(comps: DataFrame) -> DataFrame:
    """project, program, main_routine, fault_routine, disabled, safety, schedule (the id that tasks list); safety by class alone."""
    flags = attribute(1)
    p = acd.members_of(comps, "RxProgramCollection", "ProgramOrAoi").select(
        "project", F.col("name").alias("program"), number(attribute(_MAIN), 0, 4).alias("__m"), number(attribute(_FAULT), 0, 4).alias("__f"),
        F.coalesce(number(flags, _PROGRAM_DISABLED, 4) != 0, F.lit(False)).alias("disabled"), F.coalesce(number(flags, _PROGRAM_CLASS, 1) == _SAFETY, F.lit(False)).alias("safety"), "schedule", "id",
    )
    p = _named(_named(p, comps, "__m", "main_routine"), comps, "__f", "fault_routine")
    return p.select("project", "program", "main_routine", "fault_routine", "disabled", "safety", "schedule", "id")


def tasks(comps: DataFrame) -> DataFrame:
    """project, task, id, type, rate_ms, priority, watchdog_ms, safety, listed (schedule ids in order).

    Of the two layouts the first that is long enough and has a known type code holds; without either the type is Unknown."""
    cfg = attribute(1)
    t = acd.members_of(comps, "RxTaskCollection").select("project", F.col("name").alias("task"), "id", cfg.alias("cfg"))
    kind = F.create_map(*[F.lit(x) for k, v in _TASK_TYPES.items() for x in (k, v)])
    c, found = F.col("cfg"), []
    for rate, type_, priority, watchdog in _LAYOUTS:
        name = F.when(F.length(c) >= watchdog + 4, F.try_element_at(kind, number(c, type_, 2).cast("int")))
        found.append(F.when(name.isNotNull(), F.struct(name.alias("type"), number(c, priority, 2).alias("priority"), F.round(number(c, watchdog, 4) / 1000).cast("long").alias("watchdog_ms"), F.when(name == "PERIODIC", number(c, rate, 4) / 1000).alias("rate_ms"))))
    t = t.withColumn("l", F.coalesce(*found))
    # the low halves of the listed ids, as far as the data go
    fit = F.least(number(c, 0, 2), F.floor((F.length(c) - 2) / 4)).cast("int")
    low = F.expr("transform(sequence(1, __n), i -> cast(conv(hex(substring(cfg, 4 * i - 1, 1)), 16, 10) AS int) + 256 * cast(conv(hex(substring(cfg, 4 * i, 1)), 16, 10) AS int))")
    t = t.withColumn("__n", F.coalesce(fit, F.lit(0))).withColumn("listed", F.when(F.col("__n") > 0, low).otherwise(F.array().cast("array<int>")))
    safe = F.coalesce(number(c, _TASK_CLASS, 1) == _SAFETY, F.lit(False)) | F.lower("task").contains("safety")
    return t.select("project", "task", "id", F.coalesce("l.type", F.lit("Unknown")).alias("type"), "l.rate_ms", "l.priority", "l.watchdog_ms", F.when(F.length(c) >= 2, safe).otherwise(F.lit(False)).alias("safety"), "listed")


def task_programs(tasks_: DataFrame, programs_: DataFrame) -> DataFrame:
    """project, task, ord, program (null if no program has the id), schedule: what each task lists; of programs with one id the last counts."""
    own = programs_.groupBy("project", "schedule").agg(F.max_by("program", "id").alias("program"))
    rows = tasks_.select("project", "task", F.posexplode("listed").alias("ord", "schedule"))
    return rows.join(own, ["project", "schedule"], "left").select("project", "task", "ord", "program", "schedule")


def with_task_safety(programs_: DataFrame, tasks_: DataFrame, scheduled: DataFrame) -> DataFrame:
    """programs_ with safety also where a safety task runs them."""
    run = scheduled.join(tasks_.where("safety").select("project", "task"), ["project", "task"]).select("project", "program", F.lit(True).alias("__s")).distinct()
    return programs_.join(run, ["project", "program"], "left").withColumn("safety", F.col("safety") | F.coalesce("__s", F.lit(False))).drop("__s")


def tag_flags(comps: DataFrame) -> DataFrame:
    """project, scope ('' for the controller, else a program), name (lower case), safety, constant, access, connected: what tag records say."""
    flags = attribute(1)
    access = number(flags, _TAG_ACCESS, 1).bitwiseAND(F.lit(3).cast("long"))
    rows = acd.members_of(comps, "RxTagCollection").select(
        "project", "owner", F.lower("name").alias("name"), "id", _bit(number(flags, _TAG_CLASS, 1), 1).alias("safety"), _bit(number(flags, _TAG_CONSTANT, 1), 1).alias("constant"),
        F.when(F.length(flags) > _TAG_CONSTANT, F.when(access == 0, "Read/Write").when(access == 2, "Read Only")).alias("access"), attribute(_CONNECTION).isNotNull().alias("connected"),
    )
    own = acd.members_of(comps, "RxProgramCollection", "ProgramOrAoi").select("project", F.col("id").alias("owner"), F.col("name").alias("scope"))
    head = comps.where("name = 'RxProgramCollection'").select("project", F.col("parent").alias("owner"), F.lit("").alias("scope")).distinct()
    last = F.max_by(F.struct("safety", "constant", "access", "connected"), "id").alias("f")
    return rows.join(own.unionByName(head), ["project", "owner"]).groupBy("project", "scope", "name").agg(last).select("project", "scope", "name", "f.*")


def tags(defined: DataFrame, flags: DataFrame) -> DataFrame:
    """The tags of the tag index (acd_info.tags) with the flags of their records: safety, constant, access, consumed."""
    rows = defined.withColumn("__n", F.lower("name")).join(flags.withColumnRenamed("name", "__n"), ["project", "scope", "__n"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    consumed = F.coalesce("connected", F.lit(False)) & ~F.col("produced")
    return rows.select("project", "scope", "name", "data_type", "dims", "description", "produced", yes("safety"), yes("constant"), "access", consumed.alias("consumed"))


# ---------------------------------------------------------------- user-defined instructions


def aois(comps: DataFrame) -> DataFrame:
    """project, name, safety, revision, id of user-defined instructions."""
    flags = attribute(1)
    revision = F.when(F.length(flags) >= _AOI_MINOR + 2, F.concat_ws(".", number(flags, _AOI_MAJOR, 2).cast("string"), number(flags, _AOI_MINOR, 2).cast("string")))
    return acd.members_of(comps, "RxUDIDefinitionCollection", "ProgramOrAoi").select("project", "name", F.coalesce(number(flags, _AOI_CLASS, 1) == _SAFETY, F.lit(False)).alias("safety"), revision.alias("revision"), "id")


def aoi_members(comps: DataFrame, types: DataFrame, lists: DataFrame) -> DataFrame:
    """project, aoi, name, data_type, dims, parameter, usage, required, visible, created, ord, ordered: parameters and local tags.

    Usage comes from flag bits, the type from the instruction's own type (acd_info.members_of_types) or, as that lacks in-out parameters,
    from the record. The order is the stored one: of all ordered lists (acd_text.ordered_lists) the first that names exactly the
    instruction's parameters, or exactly its local tags, found by an equality join on the sorted ids; else the order of creation."""
    own = aois(comps).select("project", F.col("name").alias("aoi"), F.col("id").alias("owner"))
    flags = number(attribute(1), _TAG_FLAGS, 1)
    body = F.col("body")
    sizes = F.array(*[number(body, k, 4) for k in (26, 30, 34)])
    t = acd.members_of(comps, "RxTagCollection").join(own, ["project", "owner"]).where(~F.col("name").startswith("$") & (F.length("body") >= 18))
    t = t.select("project", "aoi", "owner", "id", "name", number(body, 16, 2).alias("created"), flags.alias("f"), F.coalesce(number(body, 42, 4), F.lit(0)).alias("__type"), F.when(F.length("body") >= 38, sizes).alias("sizes")).where("f IS NOT NULL")
    t = _named(t, comps, "__type", "own_type")
    used = F.expr("slice(sizes, 1, CASE WHEN array_position(sizes, 0) = 0 THEN 3 ELSE cast(array_position(sizes, 0) AS int) - 1 END)")
    m = types.select("project", F.col("type_name").alias("aoi"), F.lower("name").alias("__n"), F.col("data_type").alias("__d"), F.col("dims").alias("__dims")).dropDuplicates(["project", "aoi", "__n"])
    t = t.withColumn("__n", F.lower("name")).join(m, ["project", "aoi", "__n"], "left")
    local = _bit(F.col("f"), 0x10)
    usage = F.when(~local, F.when(F.col("f").bitwiseAND(F.lit(0x0C).cast("long")) == 0x0C, "InOut").when(_bit(F.col("f"), 0x08), "Output").otherwise("Input"))
    t = t.withColumn("parameter", ~local)
    sets = t.groupBy("project", "owner", "parameter").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    stored = lists.groupBy("project", F.array_sort("ids").alias("ids")).agg(F.min_by("ids", "at").alias("stored"))
    t = t.join(sets.join(stored, ["project", "ids"]).drop("ids"), ["project", "owner", "parameter"], "left")
    place = F.when(F.col("stored").isNotNull(), F.array_position("stored", F.col("id"))).otherwise(F.col("created"))
    rank = F.row_number().over(Window.partitionBy("project", "owner", "parameter").orderBy(place, "id"))
    return t.select(
        "project", "aoi", "name", F.coalesce(F.nullif("__d", F.lit("")), "own_type", F.lit("")).alias("data_type"), F.coalesce("__dims", F.when(F.size(used) > 0, used.cast("array<int>"))).alias("dims"),
        "parameter", usage.alias("usage"), (_bit(F.col("f"), 0x20) & ~local).alias("required"), (_bit(F.col("f"), 0x40) & ~local).alias("visible"), "created", (rank - 1).alias("ord"), F.col("stored").isNotNull().alias("ordered"),
    )


def aoi_args(members: DataFrame) -> DataFrame:
    """project, aoi (upper case), ord from 1, param, usage: the operands of a call after the instance, which are the required parameters."""
    p = members.where("parameter AND required AND lower(name) NOT IN ('enablein', 'enableout')").select("project", F.upper("aoi").alias("aoi"), "ord", F.col("name").alias("param"), "usage")
    return p.withColumn("ord", F.row_number().over(Window.partitionBy("project", "aoi").orderBy("ord")))


# ---------------------------------------------------------------- modules


def single(column: str) -> Column:
    """The only value of a group, null if there are several (nulls aside)."""
    return F.when(F.count_distinct(column) == 1, F.max(column))


_IP = r"(?:\d{1,3}\.){3}\d{1,3}"


def port_records(comps: DataFrame) -> DataFrame:
    """project, catalog, address: what the data records named $id$ say; the address is of the device's own port, null if none."""
    values = comps.where("length(name) = 10 AND name LIKE '$%$'").select("project", F.explode(F.map_values("attrs")).alias("v"))
    text = values.select("project", F.decode("v", "ISO-8859-1").alias("s")).where("s LIKE '<in>%'")
    ports = F.filter(F.regexp_extract_all("s", F.lit(r'(<Port [^>]*Type="EN"[^>]*>)')), lambda p: ~p.contains('Ups="False"'))
    address = F.nullif(F.regexp_extract(F.get(ports, F.lit(0)), r'Addr="([^"]+)"', 1), F.lit(""))
    return text.select("project", F.nullif(F.regexp_extract("s", r"<CatNum>([^<]+)</CatNum>", 1), F.lit("")).alias("catalog"), address.alias("address"))


def modules(comps: DataFrame) -> DataFrame:
    """project, id, module, parent, vendor, revision, address, catalog, inhibited, safety of the I/O configuration.

    The catalog number comes from the first that has one: a port record with the module's address, where the address is one module's alone
    and all its records agree; other modules of the same identity, where they agree; the controller's own record, where there is one; the
    table of known identities; and else the name of the product type."""
    a = attribute(1)
    mods = acd.members_of(comps, "RxMapDeviceCollection")
    named = acd.resolved(mods.select("project", "id", F.col("name").alias("txt")), comps, ["project", "id"]).select("project", "id", F.col("txt").alias("module"))
    ip = F.nullif(F.regexp_extract(F.decode(a, "ISO-8859-1"), f"({_IP})", 1), F.lit(""))
    network = F.substring(a, 306, 6)
    m = mods.select(
        "project", "id", (F.length(a) >= 30).alias("known"), ip.alias("ip"), number(a, 2, 2).alias("vendor_id"), number(a, 4, 2).alias("type"), number(a, 6, 2).alias("code"),
        F.concat_ws(".", number(a, 8, 1).bitwiseAND(F.lit(0x7F).cast("long")).cast("string"), number(a, 9, 1).cast("string")).alias("revision"), number(a, 22, 2).alias("up"), number(a, 28, 2).alias("slot"),
        _bit(number(a, 20, 1), 4).alias("inhibited"), (F.coalesce((F.length(a) >= 311) & (F.hex(network) != "000000000000"), F.lit(False))).alias("net"), F.when(F.length("body") >= 14, F.col("schedule")).alias("own"),
    ).withColumn("known", F.coalesce("known", F.lit(False))).join(named, ["project", "id"])
    ups = m.where("own IS NOT NULL").groupBy("project", F.col("own").alias("up")).agg(F.max_by(F.struct("id", "module"), "id").alias("p"))
    m = m.join(ups, ["project", "up"], "left").withColumn("parent", F.when(F.col("known") & (F.col("p.id") != F.col("id")), F.col("p.module")))
    m = m.withColumns({
        "safety": F.col("known") & ((F.col("net") & (F.col("type") != 14)) | F.col("type").isin(35, 42, 150)),
        "address": F.when(F.col("known"), F.coalesce("ip", F.when(F.col("parent").isNotNull(), F.col("slot").cast("string")))),
        "vendor": F.when(F.col("known"), F.when(F.col("vendor_id") == 1, "Allen-Bradley").otherwise(F.col("vendor_id").cast("string"))),
        "revision": F.when(F.col("known"), F.col("revision")),
    })
    records = port_records(comps)
    # by address
    alone = m.where("ip IS NOT NULL").groupBy("project", "ip").agg(F.count("*").alias("__k")).where("__k = 1").select("project", "ip")
    by_address = records.where("address IS NOT NULL").groupBy("project", F.col("address").alias("ip")).agg(single("catalog").alias("__a")).join(alone, ["project", "ip"])
    m = m.join(by_address, ["project", "ip"], "left").withColumn("catalog", F.when(F.col("known"), F.col("__a")))
    # by identity
    same = ["project", "vendor_id", "type", "code", "safety"]
    by_identity = m.where("known").groupBy(*same).agg(single("catalog").alias("__i"))
    m = m.join(by_identity, same, "left").withColumn("catalog", F.coalesce("catalog", "__i"))
    # the controller and its safety partner
    own = records.where(F.col("address").isNull() & F.col("catalog").rlike(r"(?i)^\d{4}-L\d+")).withColumn("sp", F.col("catalog").rlike("(?i)SP$"))
    own = own.groupBy("project").agg(F.count_if(~F.col("sp")).alias("__n"), F.max(F.when(~F.col("sp"), F.col("catalog"))).alias("__c"), F.count_if("sp").alias("__pn"), F.max(F.when(F.col("sp"), F.col("catalog"))).alias("__pc"))
    head = m.groupBy("project").agg(F.min_by(F.struct("id", "module"), F.struct(F.col("module") != "Local", "id")).alias("h"), F.min_by(F.struct("id", "module"), F.when(F.col("parent").isNull() & (F.col("type") == 14), F.col("id"))).alias("h2"))
    local = F.when(F.col("h.module") == "Local", F.col("h")).otherwise(F.col("h2"))
    m = m.join(head.select("project", local.alias("l")), "project", "left").join(own, "project", "left")
    partner = (F.col("parent") == F.col("l.module")) & F.col("module").endswith(":Partner") & (F.col("type") == 14)
    first = F.min(F.when(partner, F.col("id"))).over(Window.partitionBy("project", "parent"))
    m = m.withColumn("__first", first)
    m = m.withColumn("catalog", F.coalesce("catalog", F.when((F.col("id") == F.col("l.id")) & (F.col("__n") == 1), F.col("__c")).when((F.col("id") == F.col("__first")) & (F.col("__pn") == 1), F.col("__pc"))))
    # by table
    identity = F.concat_ws("/", F.col("vendor_id").cast("string"), F.col("type").cast("string"), F.col("code").cast("string"))
    table = F.create_map(*[F.lit(x) for k, v in tables.CATALOG.items() for x in ("/".join(map(str, k)), v)])
    kinds = F.create_map(*[F.lit(x) for k, v in tables.PRODUCT_TYPES.items() for x in (k, v)])
    kind = F.coalesce(F.try_element_at(kinds, F.col("type").cast("int")), F.concat(F.lit("product type "), F.col("type").cast("string")))
    known = F.coalesce(F.try_element_at(table, identity), F.concat(kind, F.lit(" (code "), F.col("code").cast("string"), F.lit(")")))
    return m.select("project", "id", "module", "parent", "vendor", "revision", "address", F.coalesce("catalog", F.when(F.col("known"), known)).alias("catalog"), "inhibited", "safety")


def connected(modules_: DataFrame, tags_: DataFrame, comps: DataFrame, controllers: DataFrame) -> DataFrame:
    """modules_ with safety also where a safety connection (a tag Module:SI or Module:SO) exists, and with the controller's safety partner where
    only its connection tag is there."""
    ends = tags_.where("scope = '' AND lower(name) RLIKE ':s[io]$'").select("project", F.lower(F.regexp_replace("name", r"(?i):s[io]$", "")).alias("__m"), F.lit(True).alias("__s")).distinct()
    out = modules_.withColumn("__m", F.lower("module")).join(ends, ["project", "__m"], "left").withColumn("safety", F.col("safety") | F.coalesce("__s", F.lit(False))).drop("__m", "__s")
    lone = controllers.select("project", F.concat("controller", F.lit(":Partner")).alias("module"))
    mapped = comps.where("name LIKE '\\\\_\\\\_Map:%'").select("project", F.expr("substring(name, 7)").alias("module")).distinct()
    lone = lone.join(mapped, ["project", "module"], "left_semi").join(modules_.select("project", "module"), ["project", "module"], "left_anti")
    kinds = dict(modules_.dtypes)
    fill = {"module": F.col("module"), "project": F.col("project"), "parent": F.lit("Local"), "inhibited": F.lit(False), "safety": F.lit(False)}
    return out.select(*modules_.columns).unionByName(lone.select(*[fill.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in modules_.columns]))
