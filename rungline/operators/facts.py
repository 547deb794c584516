"""The fact table of operand uses: every unit is parsed once, all else is joins and projections.

units: any key columns, n and txt (a rung, or one line of a routine). Instruction tables are fixed and small, so they are literals; tables
of a project (tags, signatures) grow with the input and their joins are left to the optimizer. Where both sides of a join have a column
project, they meet within the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rung, tables
from . import graph


def instructions(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, name, operands, text: one row for each instruction of each unit."""
    return rung.instruction_rows(units, keys)


def _within(*frames: DataFrame) -> list[str]:
    return ["project"] if all("project" in f.columns for f in frames) else []


def operands(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, name, idx, operand: one row for each operand of each instruction."""
    return instructions(units, keys).select(*keys, "pos", "name", F.posexplode("operands").alias("idx", "operand"))


def operand_uses(units: DataFrame, keys: list[str], aoi_args: DataFrame | None = None, aoi_inner: DataFrame | None = None) -> DataFrame:
    """keys, pos, instruction, operand, base, is_write, via, idx: one row for each read or write of a tag.

    aoi_args(aoi upper, ord from 1, param, usage): arguments of user-defined instructions after the instance. aoi_inner(aoi, param lower,
    suffix, is_write): what their logic does with in-out parameters. A known mnemonic hides a user-defined one of the same name."""
    return classified(operands(units, keys), keys, aoi_args, aoi_inner)


def classified(ops: DataFrame, keys: list[str], aoi_args: DataFrame | None = None, aoi_inner: DataFrame | None = None) -> DataFrame:
    """Operand rows (keys, pos, name, idx, operand) as uses."""
    out = [*keys, "pos", F.col("name").alias("instruction"), "operand", F.regexp_extract("operand", paths.BASE, 0).alias("base"), "is_write", "via", "idx"]
    if aoi_args is None:
        return _plain(ops).withColumn("via", F.lit(None).cast("string")).select(*out)
    by = _within(ops, aoi_args)
    aois = aoi_args.select(*by, F.col("aoi").alias("name")).where(~F.col("name").isin(*tables.WRITES)).distinct()
    plain = _plain(ops.join(aois, [*by, "name"], "left_anti")).withColumn("via", F.lit(None).cast("string")).select(*out)
    calls = ops.where(~F.col("name").isin(*tables.WRITES) & F.col("operand").rlike(paths.HAS_BASE)).join(aois, [*by, "name"], "left_semi")
    return plain.unionByName(_through(calls, by, aoi_args, aoi_inner).select(*out))


def _plain(ops: DataFrame) -> DataFrame:
    """Uses of known and unknown instructions; operand 0 of a jump is no tag, and of an expression every tag is read."""
    last = max(i for at in tables.WRITES.values() for i in at)
    is_write = F.lit(False)
    for i in range(last, -1, -1):
        is_write = F.when(F.col("idx") == i, F.col("name").isin(*[n for n, at in tables.WRITES.items() if i in at])).otherwise(is_write)
    ops = ops.where(~((F.col("idx") == 0) & F.col("name").isin(*tables.NAME_FIRST))).withColumn("is_write", is_write)
    found = F.filter(F.regexp_extract_all("operand", F.lit(paths.IDENTIFIER), F.lit(1)), lambda x: ~F.upper(x).isin(*tables.EXPRESSION_FUNCTIONS))
    expression = F.col("name").isin(*tables.EXPRESSIONS) & ~F.col("is_write") & ~paths.is_literal(F.col("operand"))
    ops = ops.withColumn("operand", F.explode(F.when(expression, found).otherwise(F.array("operand"))))
    return ops.where(F.col("operand").rlike(paths.HAS_BASE))  # which no literal has


def _through(calls: DataFrame, by: list[str], aoi_args: DataFrame, aoi_inner: DataFrame | None) -> DataFrame:
    """Uses by calls of user-defined instructions: the instance is written, the others follow the signature; what it doesn't say is read."""
    sign = aoi_args.select(*by, F.col("aoi").alias("name"), F.col("ord").alias("idx"), "param", "usage")
    instance = calls.where("idx = 0").withColumns({"is_write": F.lit(True), "via": F.lit("instance")})
    args = calls.where("idx > 0").join(sign, [*by, "name", "idx"], "left").withColumn("usage", F.coalesce("usage", F.lit("Input")))
    direct = args.where("usage <> 'InOut'").withColumns({"is_write": F.col("usage") == "Output", "via": F.coalesce("param", F.lit("?"))}).drop("param", "usage")
    out = instance.unionByName(direct)
    inout = args.where("usage = 'InOut'").withColumns({"p": F.lower("param"), "via": F.col("param")})
    if aoi_inner is None:
        inout = inout.withColumns({"suffix": F.lit(""), "w": F.lit(None).cast("boolean")})
    else:
        inner = aoi_inner.select(*by, F.col("aoi").alias("name"), F.col("param").alias("p"), "suffix", F.col("is_write").alias("w")).distinct()
        inout = inout.join(inner, [*by, "name", "p"], "left")
    # logic that never touches the parameter may do anything with it
    inout = inout.withColumn("is_write", F.explode(F.when(F.col("w").isNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array("w"))))
    inout = inout.withColumn("operand", F.concat("operand", F.coalesce("suffix", F.lit("")))).select(*out.columns)
    return out.unionByName(inout)


def inner_uses(uses: DataFrame) -> DataFrame:
    """aoi, param, suffix, is_write from the uses in the logic of user-defined instructions (uses with a column aoi)."""
    return uses.select(*_within(uses), "aoi", F.lower("base").alias("param"), F.expr("substr(operand, length(base) + 1)").alias("suffix"), "is_write").distinct()


def scoped(uses: DataFrame, tags: DataFrame, program: str = "program") -> DataFrame:
    """Add scope (the program's, else '' for the controller, else null), use_key and scope_base. tags: scope, name.

    Where both have a column project, names are looked up within the project, and keys hold it."""
    by = _within(uses, tags)
    own = tags.where("scope <> ''").select(*by, F.col("scope").alias("__own"), F.lower("name").alias("__name")).distinct()
    wide = tags.where("scope = ''").select(*by, F.lower("name").alias("__name"), F.lit("").alias("__wide")).distinct()
    u = uses.withColumns({"__name": F.lower("base"), "__own": F.col(program)})
    found = u.join(own.withColumn("__local", F.col("__own")), [*by, "__own", "__name"], "left").join(wide, [*by, "__name"], "left")
    found = found.withColumn("scope", F.coalesce("__local", "__wide")).drop("__own", "__name", "__local", "__wide")
    return keyed(found, F.concat_ws("|", *by, F.coalesce("scope", program)))


def keyed(uses: DataFrame, scope: Column) -> DataFrame:
    """Add scope_base, the equality key of overlap joins, and use_key."""
    return uses.withColumns({"use_key": F.concat_ws("|", scope, paths.norm(F.col("operand"))), "scope_base": F.concat_ws("|", scope, F.lower("base"))})


def overlap_pairs(some: DataFrame, others: DataFrame) -> DataFrame:
    """scope_base, use_key, other_key: the distinct paths of `some` and of `others` that overlap.

    An index of prefixes: two paths overlap where they are equal or one holds the other, so each path meets the other side's paths above
    it, and the other way round. All three joins are equalities on whole paths, so members of a tag aren't compared with each other.
    A use of a whole tag has all its members as pairs, as they do overlap."""
    a, b = some.select("scope_base", "use_key").distinct(), others.select("scope_base", F.col("use_key").alias("other_key")).distinct()
    up = lambda df, key: df.select("scope_base", key, F.explode(paths.above(F.col(key), F.col("scope_base"))).alias("at"))
    equal = a.join(b.withColumn("use_key", F.col("other_key")), ["scope_base", "use_key"])
    below = up(a, "use_key").join(b.withColumn("at", F.col("other_key")), ["scope_base", "at"]).drop("at")
    holds = up(b, "other_key").join(a.withColumn("at", F.col("use_key")), ["scope_base", "at"]).drop("at")
    return equal.unionByName(below).unionByName(holds)


def partners(some: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """Rows of `some` whose path overlaps one of `others` (how = left_semi) or none (left_anti). Only distinct paths meet; a path finds a
    partner above it, or among the paths that hold another and so are marked once, whatever lies below them."""
    mine = some.select("scope_base", "use_key").distinct()
    other = others.select("scope_base", "use_key").distinct()
    here = other.select("scope_base", F.explode(F.concat(F.array("use_key"), paths.above(F.col("use_key"), F.col("scope_base")))).alias("use_key")).distinct()
    at = mine.select("scope_base", "use_key", F.explode(paths.above(F.col("use_key"), F.col("scope_base"))).alias("__at"))
    held = at.join(other.select("scope_base", F.col("use_key").alias("__at")), ["scope_base", "__at"], "left_semi").select("scope_base", "use_key")
    met = mine.join(here, ["scope_base", "use_key"], "left_semi").unionByName(held).distinct()
    return some.join(met, ["scope_base", "use_key"], how)


def without_partner(some: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of `some` whose path overlaps none of `others` (both keyed)."""
    return partners(some, others, "left_anti")


def dangling(uses: DataFrame, write: bool, keys: list[str], extra: dict[str, tuple] | None = None) -> DataFrame:
    """Writes that nothing reads (write=True), or reads that nothing writes: by key, the first operand, instructions and number of places.

    extra: name -> (aggregate, column) over the same rows. Uses are aggregated by path before anything is compared, in one pass that is
    kept, so units are parsed once and only distinct paths meet."""
    mine = F.col("is_write") == write
    own = lambda c: F.when(mine, c)
    place = own(F.struct(*keys, "pos", "idx"))
    by_path = uses.groupBy("scope_base", "use_key").agg(
        F.bool_or(mine).alias("__mine"), F.bool_or(~mine).alias("__other"), F.min_by("operand", place).alias("operand"), F.array_sort(F.collect_set(own(F.col("instruction")))).alias("instructions"),
        F.count_distinct(own(F.struct(*keys))).alias("places"), F.every(own(F.col("via").isNotNull())).alias("via_only"), *[fn(own(c)).alias(k) for k, (fn, c) in (extra or {}).items()],
    )
    by_path = graph.kept(by_path)
    some, others = by_path.where("__mine"), by_path.where("__other")
    return without_partner(some, others).drop("__mine", "__other")


def cross_reference(uses: DataFrame, keys: list[str]) -> DataFrame:
    """For each tag, routine and instruction: the distinct unit numbers in order."""
    group = ["scope_base", "base", *[k for k in keys if k != "n"], "is_write", "instruction"]
    return uses.groupBy(*group).agg(F.array_sort(F.collect_set("n")).alias("ns"))
