"""A project's tables, facts and whole-program questions, from elements or from any unit table.

Everything is keyed by project, so a folder of projects is asked at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, rung, st, tables
from ..operators import bypass, facts, graph, safety, types
from ..sinks import routines as files
from ..sources import diagrams, l5x, projects
from . import lookups

KEYS = ["project", "program", "routine", "n"]


class Project:
    """The relations of L5X elements. Names are matched without case."""

    def __init__(self, elements: DataFrame, settings: dict | None = None):
        self.elements = e = elements
        self.settings, self.setting_faults = safety.checked(settings or {})
        self.rungs, self.lines = l5x.rungs(e), l5x.st_lines(e)
        self.tags, self.programs, self.routines = l5x.tags(e), l5x.programs(e), l5x.routines(e)
        self.aoi_args, self.aois, self.safety_map = l5x.aoi_args(e), l5x.aois(e), l5x.safety_map(e)
        self.tasks, self.scheduled = l5x.tasks(e), l5x.task_programs(e)
        self.members, self.aoi_members, self.data_types = l5x.members(e), l5x.aoi_members(e), l5x.data_types(e)
        self.modules, self.controllers = l5x.modules(e), l5x.controllers(e)

    @classmethod
    def of(cls, spark: SparkSession, settings: dict | None = None, **given: DataFrame) -> Project:
        """A project from unit tables; what isn't given has no rows. Columns that a given table lacks are null (false for safety)."""
        self = cls(spark.createDataFrame([], l5x.ELEMENTS), settings)
        for name, df in given.items():
            own = getattr(self, name)
            kinds = dict(own.dtypes)
            there = [c for c in own.columns if c in df.columns]
            rest = {c: F.lit("P") if c == "project" else F.lit(False) if c == "safety" else F.lit(None) for c in own.columns if c not in there}
            setattr(self, name, df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in there], *[v.cast(kinds[c]).alias(c) for c, v in rest.items()]).select(*own.columns))
        return self

    @classmethod
    def read(cls, spark: SparkSession, path: str, settings: dict | None = None) -> Project:
        """All projects below `path`, XML and binary files alike."""
        return cls.of(spark, settings, **projects.tables(spark, path))

    @classmethod
    def of_members(cls, members: DataFrame, settings: dict | None = None) -> Project:
        """Binary projects, from the files in their containers (acd.read_members)."""
        t = projects.binary_tables(members)
        return cls.of(members.sparkSession, settings, **{k: projects.shaped(t[k], c) for k, c in projects.COLUMNS.items()})

    # ---------------------------------------------------------------- facts

    @cached_property
    def units(self) -> DataFrame:
        """project, program, aoi, routine, n, txt, comment, is_st: every rung and every line."""
        lines = self.lines.withColumns({"comment": F.lit(None).cast("string"), "is_st": F.lit(True)})
        return self.rungs.withColumn("is_st", F.lit(False)).unionByName(lines.select(*self.rungs.columns, "is_st"))

    def _uses(self, rungs: DataFrame, lines: DataFrame, keys: list[str], inner: DataFrame | None) -> DataFrame:
        """Uses of ladder and text, calls of user-defined instructions resolved in both."""
        found = st.routine_rows(lines, [k for k in keys if k != "n"])
        names = self.aoi_args.groupBy("project").agg(F.collect_set("aoi").alias("__aois"))
        found = found.join(names, "project", "left")
        inside = F.coalesce(F.arrays_overlap("within", "__aois"), F.lit(False))
        own = found.where((F.col("kind") == "use") & ~inside).withColumn("via", F.lit(None).cast("string"))
        calls = found.where((F.col("kind") == "arg") & ~inside).where(F.array_contains("__aois", F.col("instruction"))).select(*keys, "pos", F.col("instruction").alias("name"), "idx", "operand")
        ladder = facts.operands(rungs, keys)
        both = facts.classified(ladder.unionByName(calls.select(*ladder.columns)), keys, self.aoi_args, inner)
        return both.unionByName(own.select(*both.columns))

    @cached_property
    def aoi_inner(self) -> DataFrame:
        """What the logic of user-defined instructions does with their parameters, in two passes: the second sees the calls of others. A small
        table, which is kept."""
        keys, mine = ["project", "aoi", "routine", "n"], lambda df: df.where("aoi IS NOT NULL").withColumn("aoi", F.upper("aoi"))
        first = facts.inner_uses(facts.operand_uses(mine(self.rungs), keys))
        return graph.kept(facts.inner_uses(self._uses(mine(self.rungs), mine(self.lines), keys, first)))

    def uses(self) -> DataFrame:
        """Operand uses of all programs (not of instruction definitions, which enter through their calls), with scope and keys."""
        own = "program IS NOT NULL"
        return facts.scoped(self._uses(self.rungs.where(own), self.lines.where(own), KEYS, self.aoi_inner), self.tags)

    @cached_property
    def kept_uses(self) -> DataFrame:
        """uses() written once to the checkpoint folder, for analyses that read it many times."""
        return graph.kept(self.uses())

    @cached_property
    def references(self) -> DataFrame:
        """lookups.references, kept as kept_uses is."""
        return graph.kept(lookups.references(self))

    def calls(self) -> DataFrame:
        """project, program, routine, n, target: JSR calls in ladder and text."""
        ladder = facts.instructions(self.rungs.where("program IS NOT NULL"), KEYS).where("name = 'JSR'").select(*KEYS, F.get("operands", F.lit(0)).alias("target"))
        text = st.routine_rows(self.lines.where("program IS NOT NULL"), ["project", "program", "routine"]).where("kind = 'jump'").select(*KEYS, F.col("operand").alias("target"))
        return ladder.unionByName(text).where("target IS NOT NULL")

    # ---------------------------------------------------------------- calls

    def call_edges(self) -> DataFrame:
        """project, program, src, dst: JSR targets, lower-cased."""
        return self.calls().select("project", "program", F.lower("routine").alias("src"), F.lower("target").alias("dst")).distinct()

    @staticmethod
    def _node(c):
        return F.concat_ws("|", "project", "program", F.lower(c))

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        edges = self.call_edges().select(self._node(F.col("src")).alias("src"), self._node(F.col("dst")).alias("dst"))
        seeds = self.programs.select("project", "program", F.explode(F.array("main_routine", "fault_routine")).alias("r")).where("r IS NOT NULL").select(self._node(F.col("r")).alias("node"))
        return edges, seeds

    def orphans(self) -> DataFrame:
        """Routines that no main or fault routine reaches."""
        reached = graph.reachable(*self._graph())
        return self.routines.where("program IS NOT NULL").withColumn("node", self._node(F.col("routine"))).join(reached, "node", "left_anti").select("project", "program", "routine")

    def call_tree(self) -> DataFrame:
        """project, program, routine, path, level, recursive, missing: what each main routine calls, path by path."""
        edges, _ = self._graph()
        roots = self.programs.where("main_routine IS NOT NULL").select(self._node(F.col("main_routine")).alias("node"))
        tree = graph.call_trees(edges, roots)
        known = self.routines.where("program IS NOT NULL").select(self._node(F.col("routine")).alias("node"), F.lit(True).alias("__there")).distinct()
        part = lambda k: F.split("node", "\\|")[k]
        return tree.join(known, "node", "left").select(F.expr("substring_index(node, '|', 1)").alias("project"), part(1).alias("program"), part(2).alias("routine"), F.transform("path", lambda p: F.split(p, "\\|")[2]).alias("path"), "level", "recursive", F.col("__there").isNull().alias("missing"))

    def execution_map(self) -> DataFrame:
        """project, task, ord, program, main_routine, orphans: the schedule with the routines of each program that never run."""
        lost = self.orphans().groupBy("project", "program").agg(F.array_sort(F.collect_set("routine")).alias("orphans"))
        return self.scheduled.join(self.programs.select("project", "program", "main_routine"), ["project", "program"], "left").join(lost, ["project", "program"], "left").select("project", "task", "ord", "program", "main_routine", F.coalesce("orphans", F.array().cast("array<string>")).alias("orphans"))

    def unscheduled(self) -> DataFrame:
        return self.programs.join(self.scheduled, ["project", "program"], "left_anti").select("project", "program")

    # ---------------------------------------------------------------- look-ups

    def lookup_tag(self, name: str, program: str | None = None) -> DataFrame:
        """The tag a name means in a program: its own before the controller's."""
        at = F.when(F.lower("scope") == (program or "").lower(), 0).when(F.col("scope") == "", 1)
        own = self.tags.where(F.lower("name") == name.lower()).withColumn("__p", at).where("__p IS NOT NULL")
        return own.withColumn("__k", F.row_number().over(Window.partitionBy("project").orderBy("__p"))).where("__k = 1").drop("__p", "__k")

    def xref(self, query: str, program: str | None = None) -> DataFrame:
        """Writes, then reads of a tag, or of a member with what it holds and what holds it, with each unit's text.

        Of a tag in several scopes the program's is meant, else the controller's, else the first."""
        base = paths.split_base(query)
        u = self.uses().where(F.lower("base") == base.lower())
        order = F.when(F.lower(F.coalesce("scope", "program")) == (program or "").lower(), 0).when(F.col("scope") == "", 1).otherwise(2)
        first = u.groupBy("project").agg(F.min(F.struct(order.alias("o"), F.col("scope_base").alias("scope_base"))).alias("m")).select("project", "m.scope_base")
        u = u.join(first, ["project", "scope_base"], "left_semi")
        if len(query) > len(base):
            u = u.where(paths.overlaps(paths.norm(F.col("operand")), paths.norm(F.lit(query))))
        rows = u.groupBy(*KEYS, "is_write", F.when(F.col("is_write"), F.col("instruction")).alias("instruction"), F.when(F.col("is_write"), F.col("operand")).alias("operand")).agg(F.min("pos").alias("pos"))
        return rows.join(self.units.select(*KEYS, "txt", "is_st"), KEYS).withColumn("place", paths.place(F.col("n"), F.col("is_st"))).orderBy("project", F.desc("is_write"), "program", "routine", "n", "pos").drop("pos")

    def rung(self, owner: str, routine: str, n: int, around: int = 3) -> DataFrame:
        """A unit by program (or `AOI name`) and routine; a line of text has `around` lines before and after it, and counts from 1."""
        mine = F.col("aoi") == owner[4:] if owner.startswith("AOI ") else F.col("program") == owner
        u = self.units.where(mine & (F.col("routine") == routine))
        at = F.when(F.col("is_st"), F.col("n") + 1).otherwise(F.col("n"))
        return u.withColumn("at", at).where((F.col("at") == n) | (F.col("is_st") & F.col("at").between(n - around, n + around))).select("project", "at", "txt", "comment", (F.col("at") == n).alias("hit")).orderBy("project", "at")

    @cached_property
    def member_types(self) -> DataFrame:
        """project, type_name, member (both lower case), data_type, is_array: members of types and parameters of user-defined instructions."""
        array = (F.coalesce(F.size("dims"), F.lit(0)) > 0).alias("is_array")
        udt = self.members.select("project", "type_name", "name", "data_type", array)
        aoi = self.aoi_members.where("parameter").select("project", F.col("aoi").alias("type_name"), "name", "data_type", array)
        return udt.unionByName(aoi).select("project", F.lower("type_name").alias("type_name"), F.lower("name").alias("member"), "data_type", "is_array")

    def operand_types(self, operands: DataFrame) -> DataFrame:
        """operands(project, operand, type of its base tag) with `found`, the type at the end of the path, and `array` (types.operand_types)."""
        return types.operand_types(operands, self.member_types)

    # ---------------------------------------------------------------- validation

    def issues(self, rungs: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
        """project, program, routine, n, kind, what: faults of all programs' routines, or of edited units in their place.

        Kinds: structure, instruction (unknown), call (no such routine), tag (declared nowhere; one row with its first place)."""
        rungs = self.rungs.where("program IS NOT NULL") if rungs is None else rungs
        lines = self.lines.where("program IS NOT NULL") if lines is None else lines
        out = ["project", "program", "routine", F.col("n").cast("long").alias("n"), "kind", "what"]
        named = lambda df, kind: df.withColumn("kind", F.lit(kind)).select(*out)
        shape = named(rungs.select(*KEYS, F.explode(rung.rung_problems("txt")).alias("what")), "structure")
        text = named(st.routine_problems(lines, ["project", "program", "routine"]).select("*", F.lit(None).cast("long").alias("n"), F.col("problem").alias("what")), "structure")
        known = F.col("name").isin(*tables.WRITES, *tables.ALSO_KNOWN)
        own = self.aois.select("project", F.upper("name").alias("name")).distinct()
        strange = named(facts.instructions(rungs, KEYS).where(~known).join(own, ["project", "name"], "left_anti").select(*KEYS, F.col("name").alias("what")).distinct(), "instruction")
        ladder = facts.instructions(rungs, KEYS).where("name = 'JSR' AND size(operands) > 0").select(*KEYS, F.col("operands")[0].alias("what"))
        jumps = ladder.unionByName(st.routine_rows(lines, ["project", "program", "routine"]).where("kind = 'jump'").select(*KEYS, F.col("operand").alias("what")))
        there = self.routines.where("program IS NOT NULL").select("project", "program", F.lower("routine").alias("__r")).distinct()
        lost = named(jumps.withColumn("__r", F.lower("what")).join(there, ["project", "program", "__r"], "left_anti").distinct(), "call")
        uses = facts.scoped(self._uses(rungs, lines, KEYS, self.aoi_inner), self.tags)
        unknown = named(uses.where(_UNDEFINED).groupBy("project", "program", "routine", F.col("base").alias("what")).agg(F.min("n").alias("n")), "tag")
        return shape.unionByName(text).unionByName(strange).unionByName(lost).unionByName(unknown)

    def undefined(self) -> DataFrame:
        """Tags that are used but not declared in the program or the controller; module tags and other programs' tags aside."""
        return self.uses().where(_UNDEFINED).groupBy("project", "program", "base").agg(F.array_sort(F.collect_set("n")).alias("ns"))

    # ---------------------------------------------------------------- analyses

    @cached_property
    def safety_programs(self) -> DataFrame:
        return safety.programs(self.programs, self.scheduled, self.tasks)

    @cached_property
    def marked_uses(self) -> DataFrame:
        return safety.marked(self.kept_uses, self.tags, self.safety_programs, self.safety_map, self.settings)

    def safety_instructions(self) -> DataFrame:
        return safety.instructions(self.aois, self.kept_uses, self.safety_programs, self.settings)

    def bypasses(self) -> DataFrame:
        """Findings of bypassed logic with what they shorten or disable, its operands, and whether any of these is safety-related."""
        found = bypass.findings(self.rungs.where("program IS NOT NULL"), KEYS)
        each = found.select(*KEYS, "kind", "node", F.explode("operands").alias("operand")).distinct()
        each = facts.scoped(each.withColumn("base", paths.base_tag(F.col("operand"))).where("base IS NOT NULL"), self.tags)
        safe = safety.marked(each, self.tags, self.safety_programs, self.safety_map, self.settings).groupBy(*KEYS, "kind", "node").agg(F.bool_or("safety").alias("safety"))
        return found.join(safe, [*KEYS, "kind", "node"], "left").withColumn("safety", F.coalesce("safety", F.lit(False)))

    def unconsumed(self) -> DataFrame:
        """Writes that nothing reads, but of module outputs, mapped tags, instances and one-shots."""
        return safety.unconsumed(self.marked_uses, self.settings)

    def unproduced(self) -> DataFrame:
        return safety.unproduced(self.marked_uses)

    def paths_to_sinks(self) -> DataFrame:
        return safety.paths_to_sinks(self.kept_uses, self.settings)

    def safety_devices(self) -> DataFrame:
        gone = bypass.findings(self.rungs.where("program IS NOT NULL"), KEYS).withColumn("operand", F.explode("operands"))
        gone = facts.scoped(gone.withColumn("base", paths.base_tag(F.col("operand"))).where("base IS NOT NULL"), self.tags)
        return safety.devices(self.kept_uses, self.safety_instructions(), self.aoi_args, self.paths_to_sinks(), gone)

    @cached_property
    def judged_devices(self) -> DataFrame:
        """Device calls with the outputs they are judged on and what is wrong with them, kept for the pages that list them."""
        return graph.kept(safety.judged(self.safety_devices(), self.settings))

    def safety_signals(self) -> DataFrame:
        """project, part, use_key, operand, places, instructions: core safety signals that nothing reads (unread; diagnostic, for other outputs of
        instructions) or nothing writes (partial, external), without those of orphan devices."""
        unread = safety.core(self.unconsumed(), self.marked_uses, True).withColumn("part", F.when(F.col("kind") == "aoi-output", "diagnostic").otherwise("unread"))
        lost = self.orphan_devices().select("project", F.lower("tag").alias("__b")).distinct()
        unmade = safety.core(self.unproduced(), self.marked_uses, False).withColumn("part", F.col("kind")).withColumn("__b", F.lower(F.regexp_extract("operand", r"^[^.\[]*", 0)))
        unmade = unmade.join(lost, ["project", "__b"], "left_anti")
        out = ["project", "part", "use_key", "operand", "places", "instructions"]
        return unread.where("core").select(*out).unionByName(unmade.where("core").select(*out))

    def orphan_devices(self) -> DataFrame:
        return safety.orphan_devices(self.marked_uses, self.tags, self.judged_devices)

    def coverage(self) -> DataFrame:
        return safety.coverage(self.tasks, self.programs, self.tags, self.aois, self.safety_map)

    def unused(self) -> DataFrame:
        """project, kind, name: user-defined instructions without parameters and logic that nothing calls or has as a type, and module types
        that no used type holds. User-defined types are never unused."""
        low = lambda c: F.lower(c).alias("name")
        called = facts.instructions(self.rungs, ["project"]).select("project", low("name")).unionByName(
            self.lines.select("project", F.explode(F.regexp_extract_all("txt", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))).alias("name")).select("project", low("name")))
        members, inner = self.members, self.aoi_members
        types = self.tags.select("project", low("data_type")).unionByName(members.select("project", low("data_type"))).unionByName(inner.select("project", low("data_type"))).where("name IS NOT NULL").distinct()
        some = inner.where("parameter AND lower(name) NOT IN ('enablein', 'enableout')").select("project", low("aoi")).unionByName(self.units.where("aoi IS NOT NULL").select("project", low("aoi"))).distinct()
        busy = called.unionByName(types).unionByName(some).distinct()
        idle = self.aois.where("NOT encoded").withColumn("__n", F.lower("name")).join(busy.withColumnRenamed("name", "__n"), ["project", "__n"], "left_anti").select("project", F.lit("instruction").alias("kind"), "name")
        node = lambda c: F.concat_ws("|", "project", F.lower(c))
        edges = members.select(node("type_name").alias("src"), node("data_type").alias("dst"))
        reached = graph.reachable(edges, types.select(node("name").alias("node")))
        rest = self.data_types.where("kind <> 'udt'").withColumn("node", node("name")).join(reached, "node", "left_anti").select("project", F.lit("type").alias("kind"), "name")
        return idle.unionByName(rest)

    def undecoded(self) -> DataFrame:
        return self.routines.where("undecoded IS NOT NULL").select("project", "program", "aoi", "routine", "undecoded")

    # ---------------------------------------------------------------- documents

    def rendered(self) -> DataFrame:
        """project, program, aoi, routine, n, txt: diagrams as readable lines."""
        return diagrams.fbd_lines(self.elements).unionByName(diagrams.sfc_lines(self.elements))

    def routine_files(self, only: DataFrame | None = None) -> DataFrame:
        """The text of every routine's file, or of those in only(project, program, aoi, routine)."""
        drawn = self.rendered().withColumns({"comment": F.lit(None).cast("string"), "is_st": F.lit(True)})
        routines, units = self.routines, self.units.unionByName(drawn.select(*self.units.columns))
        if only is not None:
            key = lambda df: df.withColumns({"__p": F.coalesce("program", F.lit("")), "__a": F.coalesce("aoi", F.lit(""))})
            some = key(only).select("project", "__p", "__a", "routine").distinct()
            routines, units = (key(df).join(some, ["project", "__p", "__a", "routine"], "left_semi").drop("__p", "__a") for df in (routines, units))
        return files.routine_files(routines, units)

    # ---------------------------------------------------------------- look-ups of many

    def find_usage(self, wanted: DataFrame) -> DataFrame:
        """Where each of wanted(project, tag, program) is written and read, and in which line of which file (lookups.find_usage)."""
        return lookups.find_usage(self, wanted)

    def meanings(self, asked: DataFrame | None = None) -> DataFrame:
        """What words mean (lookups.meanings); by default every word of all units."""
        return lookups.meanings(self, lookups.words(self) if asked is None else asked)

    def import_files(self) -> DataFrame:
        named = self.routines.join(self.controllers.select("project", "controller"), "project", "left")
        return files.import_files(named, self.units)

    def tags_csv(self) -> DataFrame:
        n = self.kept_uses.groupBy("project", F.coalesce("scope", "program").alias("scope"), F.lower("base").alias("name")).agg(F.count_if(~F.col("is_write")).alias("reads"), F.count_if("is_write").alias("writes"))
        return files.tags_csv(self.tags, n)

    def summary(self) -> DataFrame:
        """project, what, n: the counts of a project's summary page."""
        part = lambda df, what: df.groupBy("project").agg(F.count("*").alias("n")).select("project", F.lit(what).alias("what"), "n")
        kinds = self.routines.groupBy("project", F.concat(F.lit("routines "), F.col("type")).alias("what")).agg(F.count("*").alias("n"))
        parts = [kinds, part(self.rungs, "rungs"), part(self.lines, "lines"), part(self.tags, "tags"), part(self.tags.where("safety"), "safety tags"), part(self.aois, "instructions"), part(self.programs, "programs"), part(self.tasks, "tasks")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


_UNDEFINED = "scope IS NULL AND base NOT LIKE '\\\\\\\\%' AND base NOT LIKE '%:%'"
