"""Safety analyses over keyed uses: which tags are safety-related, signals nothing produces, devices and what their outputs reach.

All take uses with project, program, routine, n, use_key, scope_base (facts.scoped) and relations of the project; settings are regular
expressions over names, matched without case."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from . import facts
from .graph import nearest_sink

UNIT = ["project", "program", "routine", "n"]


@dataclass
class Settings:
    """names: operands that sound safety-related; device: names of device instructions; sinks: what a signal may end in, best first;
    result: members that are a device's result; mapped: names of tags that mapping fills."""

    names: str | None = None
    device: str | None = None
    sinks: list[str] = field(default_factory=list)
    result: str | None = None
    mapped: str | None = None


def checked(settings: dict) -> tuple[Settings, list[str]]:
    """Settings from a dict; patterns that don't compile are left out and reported."""
    faults: list[str] = []

    def sound(pattern: str | None, where: str) -> str | None:
        if not pattern or not pattern.strip():
            return None
        try:
            re.compile(pattern)
        except re.error as e:
            faults.append(f"{where}: {e}")
            return None
        return pattern

    one = {k: sound(settings.get(k), k) for k in ("names", "device", "result", "mapped")}
    sinks = [p for i, x in enumerate(settings.get("sinks", [])) if (p := sound(x, f"sinks[{i}]"))]
    return Settings(**one, sinks=sinks), faults


def _like(c: Column, pattern: str | None) -> Column:
    return c.rlike(f"(?i){pattern}") if pattern else F.lit(False)


def sink_rank(operand: Column, base: Column, settings: Settings) -> Column:
    """1000 for an output module, 100 - i for the i-th sink pattern, else 0."""
    rank = F.lit(0)
    for i in reversed(range(len(settings.sinks))):
        rank = F.when(_like(operand, settings.sinks[i]), 100 - i).otherwise(rank)
    return F.when(paths.is_output_module(base), 1000).otherwise(rank)


def programs(programs_: DataFrame, scheduled: DataFrame, tasks: DataFrame) -> DataFrame:
    """project, program of the safety scope: marked as safety, or scheduled in a safety task."""
    run = scheduled.join(tasks.where("safety").select("project", "task"), ["project", "task"], "left_semi").select("project", "program")
    return programs_.where("safety").select("project", "program").unionByName(run).distinct()


def instructions(aois: DataFrame, uses: DataFrame, safe: DataFrame, settings: Settings) -> DataFrame:
    """project, aoi (upper case): of safety class, named as devices, or called from a safety program."""
    own = aois.where(F.col("safety") | _like(F.col("name"), settings.device)).select("project", F.upper("name").alias("aoi"))
    called = uses.where("via IS NOT NULL").join(safe, ["project", "program"], "left_semi").select("project", F.col("instruction").alias("aoi"))
    return own.unionByName(called).distinct()


def marked(uses: DataFrame, tags: DataFrame, safe: DataFrame, mapping: DataFrame, settings: Settings) -> DataFrame:
    """uses with safety, core, mapped_safety and mapped_standard.

    A use is safety-related by its name, by its tag's class, or by a scope that is a safety program; a tag that is declared nowhere
    belongs to the program that uses it. Names alone make no core: that is the class of the tag, its scope, or the program that uses it."""
    where = F.coalesce("scope", "program")
    classed = tags.where("safety").select("project", F.col("scope").alias("__scope"), F.lower("name").alias("__name"), F.lit(True).alias("__class")).distinct()
    scopes = safe.select("project", F.col("program").alias("__scope"), F.lit(True).alias("__safe"))
    pairs = [mapping.select("project", F.lower(c).alias("__name"), F.lit("").alias("__scope"), F.lit(True).alias(f"__{c}")).distinct() for c in ("safety", "standard")]
    u = uses.withColumns({"__scope": where, "__name": F.lower("base")})
    u = u.join(classed, ["project", "__scope", "__name"], "left").join(scopes, ["project", "__scope"], "left")
    u = u.join(safe.select("project", "program", F.lit(True).alias("__ran")), ["project", "program"], "left")
    for p in pairs:
        u = u.join(p, ["project", "__scope", "__name"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return u.withColumns({
        "safety": _like(F.col("operand"), settings.names) | yes("__class") | yes("__safe"),
        "core": yes("__class") | yes("__safe") | yes("__ran"),
        "mapped_safety": yes("__safety") | _like(F.col("__name"), settings.mapped),
        "mapped_standard": yes("__standard"),
    }).drop("__scope", "__name", "__class", "__safe", "__ran", "__safety", "__standard")


def unconsumed(uses: DataFrame, settings: Settings) -> DataFrame:
    """Writes that nothing reads, but of output modules, mapped standard tags, instances and one-shot storage: use_key, operand, instructions,
    places, kind (aoi-output: written by user-defined instructions alone and not a device's result), safety."""
    inner = (F.col("via") == "instance").eqNullSafe(True) | (F.col("instruction").isin("ONS", "OSR", "OSF") & (F.col("idx") == 0))
    mine = uses.where(~F.col("is_write") | ~(inner | paths.is_output_module(F.col("base")) | F.col("mapped_standard")))
    got = facts.dangling(mine, True, UNIT, {"safety": (F.bool_or, F.col("safety")), "project": (F.max, F.col("project"))})
    kind = F.when(F.col("via_only") & ~_like(F.col("operand"), settings.result), "aoi-output")
    return got.select("project", "use_key", "operand", "instructions", "places", kind.alias("kind"), "safety")


def unproduced(uses: DataFrame) -> DataFrame:
    """Safety-related reads that nothing writes, but of modules: kind is partial if logic writes other members of the tag, else external."""
    module = paths.is_input_module(F.col("base")) | paths.is_output_module(F.col("base"))
    mine = uses.where(F.col("is_write") | (F.col("safety") & ~module))
    got = facts.dangling(mine, False, UNIT, {"mapped": (F.bool_or, F.col("mapped_safety")), "project": (F.max, F.col("project"))})
    some = uses.where("is_write").select("scope_base", F.lit(True).alias("__w")).distinct()
    kind = F.when(F.col("__w").isNull() | F.col("mapped"), "external").otherwise("partial")
    return got.join(some, "scope_base", "left").select("project", "use_key", "operand", "instructions", "places", kind.alias("kind"))


def hops(uses: DataFrame) -> DataFrame:
    """src, dst, ref: in a unit, every read path feeds every written path. A written path reaches the reads that it overlaps.

    Nodes are written paths; the pairs of a unit are its own reads and writes, which a rung holds few of."""
    reads, writes = uses.where("NOT is_write"), uses.where("is_write")
    read = reads.select(*UNIT, F.col("use_key").alias("other_key"), "scope_base").distinct()
    into = facts.overlap_pairs(writes, reads).join(read, ["scope_base", "other_key"]).select(F.col("use_key").alias("src"), *UNIT).distinct()
    return into.join(writes.select(*UNIT, F.col("use_key").alias("dst")).distinct(), UNIT).select("src", "dst", *UNIT)


def paths_to_sinks(uses: DataFrame, settings: Settings, hops_: int = 12) -> DataFrame:
    """use_key, unit, sink, hops, chain for each written path and the unit that writes it: 0 hops if it is a sink itself, else a sink that the
    same unit writes outside user-defined instructions, else the best-ranked one at the least number of hops, the first of which is through
    another unit. The chain has the written paths from the start to the sink."""
    writes = uses.where("is_write").withColumn("rank", sink_rank(F.col("operand"), F.col("base"), settings))
    starts = writes.groupBy("use_key", *UNIT).agg(F.max("rank").alias("rank"), F.min("operand").alias("operand"))
    beside = writes.where("rank > 0 AND via IS NULL").groupBy(*UNIT).agg(F.max_by("operand", F.struct("rank", -F.col("pos"), -F.col("idx"))).alias("near"))
    sinks = writes.where("rank > 0").groupBy(F.col("use_key").alias("node")).agg(F.max("rank").alias("rank"), F.min("operand").alias("operand"))
    steps = hops(uses).where("src <> dst").distinct()
    # the first hop goes through another unit than the start's own; the rest is a search from where it leads
    own = F.struct(*UNIT)
    first = steps.select(F.col("src").alias("use_key"), F.struct(*UNIT).alias("__through"), F.col("dst").alias("node"))
    start = starts.select("use_key", own.alias("unit")).distinct().join(first, "use_key").where(F.col("unit") != F.col("__through")).select(F.struct("use_key", "unit").alias("start"), "node").distinct()
    found = nearest_sink(steps.select("src", "dst"), start, sinks.select("node", "rank"), hops_ - 1)
    far = found.join(sinks.select(F.col("node").alias("sink"), F.col("operand").alias("far")), "sink").select("start.use_key", "start.unit.*", "far", (F.col("hops") + 1).alias("far_hops"), F.col("chain").alias("far_chain"))
    both = starts.join(beside, UNIT, "left").join(far, ["use_key", *UNIT], "left")
    sink = F.when(F.col("rank") > 0, F.col("operand")).otherwise(F.coalesce("near", "far"))
    count = F.when((F.col("rank") > 0) | F.col("near").isNotNull(), 0).otherwise(F.col("far_hops"))
    chain = F.when(count == 0, F.array("use_key")).otherwise(F.concat(F.array("use_key"), "far_chain"))
    return both.select("use_key", *UNIT, sink.alias("sink"), count.alias("hops"), chain.alias("chain")).where("sink IS NOT NULL")


def devices(uses: DataFrame, safe_aois: DataFrame, aoi_args: DataFrame, reached: DataFrame, bypassed: DataFrame) -> DataFrame:
    """One row for each unit and safety instruction it calls: instance, inputs, objects, and outputs with consumers, sink, hops, chain, the
    number of bypasses and their first places.

    bypassed: UNIT, scope_base, use_key of bypassed operands. A consumer is another unit that reads what overlaps the output. Outputs that
    differ in case alone, as one instruction may write a member on more than one path, are one: their consumers and bypasses are united."""
    calls = uses.where("via IS NOT NULL").join(safe_aois.withColumnRenamed("aoi", "instruction"), ["project", "instruction"], "left_semi")
    calls = calls.join(aoi_args.select("project", F.col("aoi").alias("instruction"), F.col("param").alias("via"), "usage"), ["project", "instruction", "via"], "left")
    key = [*UNIT, "instruction"]
    outputs = calls.where("is_write AND via <> 'instance'").select(*key, "operand", "use_key", "scope_base").distinct()
    unit = F.struct(*UNIT)
    at = lambda others: facts.overlap_pairs(outputs, others).join(others.select("scope_base", F.col("use_key").alias("other_key"), unit.alias("at")).distinct(), ["scope_base", "other_key"]).select("scope_base", "use_key", "at").distinct()
    same = F.lower("operand")
    member = outputs.select(*key, "scope_base", "use_key", same.alias("same"))
    count = lambda df, name: df.groupBy(*key, "same").agg(F.count_distinct("at").alias(name))
    read = count(member.join(at(uses.where("NOT is_write")), ["scope_base", "use_key"]).where(F.col("at") != unit), "consumers")
    gone = member.join(at(bypassed), ["scope_base", "use_key"]).select(*key, "same", "at").distinct()
    order = Window.partitionBy(*key, "same").orderBy("at")
    first = gone.withColumn("k", F.row_number().over(order)).groupBy(*key, "same").agg(F.count("*").alias("bypassed"), F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("at")))).alias("places"))
    ends = outputs.join(reached, ["use_key", *UNIT], "left").groupBy(*key, same.alias("same")).agg(F.min("operand").alias("operand"), F.min(F.when(F.col("sink").isNotNull(), F.struct("hops", "sink", "chain"))).alias("m"))
    used = ends.join(read, [*key, "same"], "left").join(first, [*key, "same"], "left")
    out = F.struct("operand", F.coalesce("consumers", F.lit(0)).alias("consumers"), F.col("m.sink").alias("sink"), F.col("m.hops").alias("hops"), F.coalesce("bypassed", F.lit(0)).alias("bypassed"), "places", F.col("m.chain").alias("chain"))
    outs = used.groupBy(*key).agg(F.array_sort(F.collect_list(out)).alias("outputs"))
    text = lambda when, what: F.array_sort(F.collect_set(F.when(when, what)))
    head = calls.groupBy(*key).agg(
        F.max(F.when(F.col("via") == "instance", F.col("operand"))).alias("instance"),
        text(~F.col("is_write") & (F.col("usage") == "Input"), F.struct(F.col("via").alias("param"), F.col("operand").alias("value"))).alias("inputs"),
        text(F.col("usage") == "InOut", F.col("scope_base")).alias("objects"),
    )
    return head.join(outs, key, "left").withColumnRenamed("instruction", "aoi")


def judged(devices_: DataFrame, settings: Settings) -> DataFrame:
    """devices with `judged`, the outputs a device is judged on, and `problems`, what is wrong with it (none: an empty list).

    Judged are the outputs that are the configured result, else those that other logic reads, else all. A device is at fault if it writes
    no output, none of the judged is read, none of the read ones reaches a sink, or one of them is bypassed."""
    outs = F.coalesce("outputs", F.array().cast(devices_.schema["outputs"].dataType))
    is_read = lambda o: o["consumers"] > 0
    named = F.filter(outs, lambda o: _like(o["operand"], settings.result))
    read_ = F.filter(outs, is_read)
    d = devices_.withColumn("judged", F.when(F.size(named) > 0, named).when(F.size(read_) > 0, read_).otherwise(outs))
    d = d.withColumn("__read", F.filter("judged", is_read))
    short = lambda o: F.when(F.size("__read") > 1, o["operand"]).otherwise(F.concat(F.when(F.instr(o["operand"], ".") > 0, ".").otherwise(""), F.substring_index(o["operand"], ".", -1)))
    where = lambda o: F.array_join(F.transform(o["places"], lambda p: F.concat(p["program"], F.lit("/"), p["routine"], F.lit("#"), p["n"].cast("string"))), ", ")
    more = lambda o: F.when(o["bypassed"] > F.size(o["places"]), F.concat(F.lit(" and "), (o["bypassed"] - F.size(o["places"])).cast("string"), F.lit(" more"))).otherwise("")
    gone = F.transform(F.filter("__read", lambda o: o["bypassed"] > 0), lambda o: F.concat(short(o), F.lit(" bypassed at "), where(o), more(o)))
    unread = F.lit("not consumed") if settings.result else F.lit("no output is read")
    unread = F.when(F.size("judged") == 1, unread).otherwise("no output is read")
    lost = F.when(~F.exists("__read", lambda o: o["sink"].isNotNull()), F.array(F.lit("reaches no output"))).otherwise(F.array().cast("array<string>"))
    said = F.when(F.size("judged") == 0, F.array(F.lit("writes no output"))).when(F.size("__read") == 0, F.array(unread)).otherwise(F.concat(lost, gone))
    return d.withColumn("problems", said).drop("__read")


def core(dangling: DataFrame, uses: DataFrame, write: bool) -> DataFrame:
    """dangling rows (use_key) with `core`: whether a use on this side lies in a safety program or is of a tag of safety class (uses marked)."""
    at = uses.where(F.col("is_write") == write).groupBy("use_key").agg(F.bool_or("core").alias("core"))
    return dangling.join(at, "use_key", "left").withColumn("core", F.coalesce("core", F.lit(False)))


def orphan_devices(uses: DataFrame, tags: DataFrame, devices_: DataFrame) -> DataFrame:
    """project, scope, tag, data_type, readers, core: tags of a type passed as a device object that logic reads and nothing writes or maps. Core
    are those on the safety side; the others are leftovers of standard logic."""
    t = tags.withColumn("scope_base", F.concat_ws("|", "project", "scope", F.lower("name")))
    kinds = devices_.select(F.explode("objects").alias("scope_base")).distinct().join(t, "scope_base").select("project", F.lower("data_type").alias("kind")).distinct()
    read = uses.where("NOT is_write AND NOT mapped_safety").groupBy("scope_base").agg(F.count_distinct(*UNIT).alias("readers"), F.bool_or("core").alias("core"))
    written = uses.where("is_write").select("scope_base").distinct()
    mine = t.withColumn("kind", F.lower("data_type")).join(kinds, ["project", "kind"], "left_semi")
    return mine.join(read, "scope_base").join(written, "scope_base", "left_anti").select("project", "scope", F.col("name").alias("tag"), "data_type", "readers", "core")


def coverage(tasks: DataFrame, programs_: DataFrame, tags: DataFrame, aois: DataFrame, mapping: DataFrame) -> DataFrame:
    """project, warning: what safety information a project lacks."""
    flag = lambda df, c, name: df.groupBy("project").agg(F.bool_or(c).alias(name))
    p = flag(tasks, F.col("safety"), "task").join(flag(programs_, F.col("safety"), "program"), "project", "full").join(flag(tags, F.col("safety"), "tag"), "project", "full")
    p = p.join(flag(tags.where("scope = ''"), F.col("safety"), "wide"), "project", "full").join(flag(aois, F.col("safety"), "aoi"), "project", "full").join(flag(mapping, F.lit(True), "map"), "project", "full").na.fill(False)
    said = [
        (~F.col("task") & (F.col("tag") | F.col("aoi")), "safety tags or instructions but no safety task"),
        (F.col("task") & ~F.col("program"), "a safety task but no safety program"),
        (F.col("task") & ~F.col("tag"), "a safety task but no safety tags"),
        (F.col("task") & ~F.col("map") & F.col("wide"), "no safety tag map: mapped tags may look unproduced"),
    ]
    return p.select("project", F.explode(F.array_compact(F.array(*[F.when(c, t) for c, t in said]))).alias("warning"))
