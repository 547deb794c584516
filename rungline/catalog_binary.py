"""Queries over project files: binary containers and XML made from the part table, 200 parts a project, and trees of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ORACLE, QUERIES, long, query
from .operators import aoi_order, graph
from .plans.project import Project
from .sinks import pages
from .sources import acd, acd_info, acd_model, acd_text, l5x, synth_acd
from .sources.synth import by_project, table

__all__ = ["ORACLE", "QUERIES"]

#: part with its project, key and size as all queries here read it
_P = "SELECT concat('K', CAST(floor(p_partkey / 200) AS BIGINT)) AS project, CAST(floor(p_partkey / 200) AS BIGINT) AS k, CAST(p_partkey AS BIGINT) AS i, CAST(p_size AS BIGINT) AS z FROM part"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kept(synth_acd.members(spark, sf_dir))


@query(f"""SELECT project, concat('P', i) AS program, 'Main' AS routine, CAST(0 AS BIGINT) AS n, concat('XIC(In', i, '.B0)OTE(In', i, '.B', z % 12, ');') AS txt, CASE WHEN z % 2 = 1 AND i % 1000 <> 0 THEN concat('note ', z) END AS comment, CAST(0 AS BIGINT) AS unresolved FROM ({_P})
UNION ALL SELECT project, concat('P', i), 'Main', 1, CASE WHEN z % 7 = 0 THEN 'XIC(@00000bad@)NOP();' ELSE 'NOP();' END, NULL, CASE WHEN z % 7 = 0 THEN 1 ELSE 0 END FROM ({_P})""")
def acd_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs of binary projects in region order, with names in place of ids and their comments (S-03, S-04, S-07 to S-14, P-20, J-05, J-06, G-08, W-04, A-04)."""
    m = _members(spark, sf_dir)
    return acd.rungs(m, graph.stored(acd.comps(m))).select("project", "program", "routine", "n", "txt", "comment", long(F.col("unresolved")).alias("unresolved"))


_SECOND = "(i % 3 <> 0 OR i % 2 = 0)"


@query(f"""SELECT project, concat('P', i) AS program, j AS n, CASE WHEN j = 4 THEN '' ELSE concat('  x', j, ' := In', i, '.B0;', CASE WHEN z % 10 = 0 THEN repeat(' ', 300) ELSE '' END) END AS txt, j = 4 AS missing FROM ({_P}), (SELECT unnest(range(5)) AS j) WHERE {_SECOND} AND j < z % 6
UNION ALL SELECT project, concat('P', i), j, CASE j WHEN 0 THEN 'other' ELSE '' END, j = 1 FROM ({_P}), (SELECT unnest(range(2)) AS j) WHERE NOT {_SECOND}""")
def acd_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Text of binary projects: routine, accepted document, lines (S-15, S-18, J-07)."""
    m = _members(spark, sf_dir)
    comps = graph.stored(acd.comps(m))
    return acd_text.routine_lines(graph.stored(acd_text.unnamed(m)), acd.routines(comps), comps).select("project", "program", "n", "txt", "missing")


@query(f"SELECT project, i * 100 + 1004 AS owner, 200 * i + CASE WHEN {_SECOND} THEN 2 ELSE 1 END AS document, {_SECOND} OR z % 6 > 0 AS pending FROM ({_P})")
def acd_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted document of each text routine, and whether another one holds edits (S-15, J-07)."""
    return acd_text.st_documents(graph.stored(acd_text.unnamed(_members(spark, sf_dir)))).select("project", "owner", "document", "pending")


@query(f"SELECT project, concat('In', i) AS standard, concat('U', i) AS safety FROM ({_P}) WHERE i % 5 = 0")
def acd_safety_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safety tag map of binary projects (S-17)."""
    m = _members(spark, sf_dir)
    return acd_text.safety_map(graph.stored(acd_text.unnamed(m)), graph.stored(acd.comps(m))).select("project", "standard", "safety")


@query(f"""SELECT project, concat('C', k) AS controller, concat(CASE WHEN k % 30 + 10 >= 21 THEN 'Studio 5000 Logix Designer' ELSE 'RSLogix 5000' END, ' v', k % 30 + 10, '.01') AS software, concat(k, '.0') AS revision, CAST(7 AS BIGINT) AS product_code
  FROM (SELECT DISTINCT project, k FROM ({_P}))""")
def acd_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of binary projects (S-19)."""
    return acd_info.controllers(_members(spark, sf_dir)).select("project", "controller", "software", "revision", "product_code")


@query(f"""SELECT project, concat('U', i) AS type_name, concat('Z', j) AS name, 'SINT' AS data_type, CAST(-1 AS BIGINT) AS bit, CAST(NULL AS VARCHAR) AS target FROM ({_P}), (SELECT unnest(range(2)) AS j)
UNION ALL SELECT project, concat('U', i), concat('B', j), 'BIT', j % 8, concat('Z', j // 8) FROM ({_P}), (SELECT unnest(range(12)) AS j) WHERE j <= z % 12
UNION ALL SELECT project, concat('U', i), 'Far', 'BOOL', 40, NULL FROM ({_P})""")
def acd_type_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of binary projects, with packed bits in their hidden hosts (S-20, S-21)."""
    e = graph.stored(acd_info.elements(_members(spark, sf_dir)))
    return acd_info.members_of_types(e).select("project", "type_name", "name", "data_type", long(F.coalesce("bit", F.lit(-1))).alias("bit"), "target")


@query(f"""SELECT project, '' AS scope, concat('in', i) AS name, concat('U', i) AS data_type, CASE WHEN z % 5 = 0 THEN CAST(z AS VARCHAR) ELSE '' END AS dims, i % 3 = 0 AS safety, i % 4 = 0 AS constant, CASE i % 4 WHEN 0 THEN 'Read/Write' WHEN 2 THEN 'Read Only' END AS access, i % 12 = 0 AS produced, i % 6 = 0 AND i % 12 <> 0 AS consumed FROM ({_P})
UNION ALL SELECT project, concat('P', i), 'Loc', 'DINT', '', false, false, NULL, false, false FROM ({_P})""")
def acd_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of binary projects with the flags of their records (S-20, S-28, J-24)."""
    m = _members(spark, sf_dir)
    got = acd_model.tags(acd_info.tags(graph.stored(acd_info.elements(m))), acd_model.tag_flags(graph.stored(acd.comps(m))))
    return got.select("project", "scope", "name", "data_type", F.coalesce(F.array_join(F.col("dims").cast("array<string>"), ","), F.lit("")).alias("dims"), "safety", "constant", "access", "produced", "consumed")


_USAGE = "CASE j % 3 WHEN 0 THEN 'Input' WHEN 1 THEN 'Output' ELSE 'InOut' END"


@query(f"""SELECT project, concat('A', i) AS aoi, array_to_string(list(concat('p', j, ':', {_USAGE}, CASE WHEN j = 0 THEN '[4]' ELSE '' END) ORDER BY CASE WHEN i % 2 = 1 THEN -j WHEN j = 0 THEN 99 ELSE j END), ',') AS params, i % 2 = 0 AS ordered
  FROM ({_P}), (SELECT unnest(range(5)) AS j) WHERE j < z % 4 + 2 GROUP BY project, i""")
def acd_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of user-defined instructions in their stored order, else in that of creation (S-16, S-26, J-14)."""
    m = _members(spark, sf_dir)
    types = acd_info.members_of_types(graph.stored(acd_info.elements(m)))
    got = acd_model.aoi_members(graph.stored(acd.comps(m)), types, acd_text.ordered_lists(graph.stored(acd_text.unnamed(m)))).where("parameter")
    text = F.concat("name", F.lit(":"), "usage", F.when(F.col("dims").isNotNull(), F.concat(F.lit("["), F.array_join(F.col("dims").cast("array<string>"), ","), F.lit("]"))).otherwise(""))
    return got.groupBy("project", "aoi", "ordered").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", text.alias("t"))))["t"], ",").alias("params"))


@query(f"""SELECT t.project, concat('T', t.i) AS task, CASE t.z % 3 WHEN 0 THEN 'EVENT' WHEN 1 THEN 'PERIODIC' ELSE 'CONTINUOUS' END AS type, CASE WHEN t.z % 3 = 1 THEN CAST(t.z AS DOUBLE) END AS rate_ms, t.z % 16 AS priority, t.i % 40 = 0 AS safety, j AS ord, CASE WHEN p.i IS NOT NULL THEN concat('P', p.i) END AS program
  FROM ({_P}) t JOIN (SELECT unnest(range(3)) AS j) ON t.i % 10 = 0 LEFT JOIN ({_P}) p ON p.project = t.project AND p.i = t.i + CASE j WHEN 2 THEN 300 ELSE j END""")
def acd_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of binary projects, of either layout, and the programs that they list; an id that no program has stays null (S-27, J-08)."""
    comps = graph.stored(acd.comps(_members(spark, sf_dir)))
    tasks = acd_model.tasks(comps)
    listed = acd_model.task_programs(tasks, acd_model.programs(comps))
    return listed.join(tasks, ["project", "task"]).select("project", "task", "type", "rate_ms", "priority", "safety", long(F.col("ord")).alias("ord"), "program")


@query(f"""SELECT project, concat('P', i) AS program, 'Main' AS main_routine, i % 9 = 0 AS disabled, i % 10 = 0 OR EXISTS (SELECT 1 FROM part t WHERE t.p_partkey % 40 = 0 AND i - t.p_partkey IN (0, 1) AND floor(t.p_partkey / 200) = k) AS safety FROM ({_P})""")
def acd_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of binary projects; those that a safety task runs are safety programs too (S-25, J-08)."""
    comps = graph.stored(acd.comps(_members(spark, sf_dir)))
    tasks, programs = acd_model.tasks(comps), acd_model.programs(comps)
    return acd_model.with_task_safety(programs, tasks, acd_model.task_programs(tasks, programs).where("program IS NOT NULL")).select("project", "program", "main_routine", "disabled", "safety")


_ADDRESS = "CASE WHEN z % 2 = 0 THEN concat('10.', a // 40000, '.', a // 200 % 200, '.', a % 200) END"
_KIND = "CASE t WHEN 7 THEN 'General Purpose Discrete I/O' WHEN 10 THEN 'General Purpose Analog I/O' WHEN 14 THEN 'Programmable Logic Controller' ELSE 'Safety Discrete I/O Device' END"


@query(f"""WITH m AS (SELECT *, CASE WHEN i % 16 = 1 THEN i - 1 ELSE i END AS a, CASE WHEN i % 3 <> 0 THEN 1 ELSE 40 END AS v, CASE i % 4 WHEN 0 THEN 7 WHEN 1 THEN 10 WHEN 2 THEN 14 ELSE 35 END AS t, z % 3 AS c, i % 8 = 1 OR i % 4 = 3 AS safety FROM ({_P})),
ip AS (SELECT *, {_ADDRESS} AS ip FROM m), n AS (SELECT *, count(*) OVER (PARTITION BY project, ip) AS same FROM ip),
f AS (SELECT *, CASE WHEN ip IS NOT NULL AND same = 1 AND i % 4 < 2 THEN concat('CAT', z % 4) END AS own FROM n),
g AS (SELECT *, CASE WHEN min(own) OVER w = max(own) OVER w THEN min(own) OVER w END AS shared FROM f WINDOW w AS (PARTITION BY project, v, t, c, safety)),
p AS (SELECT g.*, CASE WHEN u.i IS NOT NULL AND u.i <> g.i THEN concat('M', u.i) END AS parent FROM g LEFT JOIN ({_P}) u ON u.project = g.project AND u.i = g.i // 3)
SELECT project, concat('M', i) AS module, parent, CASE v WHEN 1 THEN 'Allen-Bradley' ELSE CAST(v AS VARCHAR) END AS vendor, concat(z, '.3') AS revision, coalesce(ip, CASE WHEN parent IS NOT NULL THEN CAST(z AS VARCHAR) END) AS address,
  coalesce(own, shared, concat({_KIND}, ' (code ', c, ')')) AS catalog, i % 5 = 0 AS inhibited, safety FROM p""")
def acd_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of binary projects with their catalog numbers, by address, by identity, by product type (S-22 to S-24, J-10, A-05)."""
    return acd_model.modules(graph.stored(acd.comps(_members(spark, sf_dir)))).select("project", "module", "parent", "vendor", "revision", "address", "catalog", "inhibited", "safety")


@query(f"""WITH l AS (SELECT i, j FROM ({_P}), (SELECT unnest(range(5)) AS j) WHERE {_SECOND} AND j < z % 6 AND j <> 4),
u AS (SELECT concat('In', i) AS base, false AS is_write FROM ({_P}) UNION ALL SELECT concat('In', i), true FROM ({_P}) UNION ALL SELECT concat('In', i), false FROM l UNION ALL SELECT concat('x', j), true FROM l
  UNION ALL SELECT 'other', false FROM ({_P}) WHERE NOT {_SECOND}) SELECT base, is_write, CAST(count(*) AS BIGINT) AS n_uses FROM u GROUP BY ALL""")
def acd_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of binary projects, through the same Project as XML files (S-01, S-25, X-16)."""
    units = Project.of_members(_members(spark, sf_dir)).uses()
    return units.where("base <> '@00000bad@'").groupBy("base", "is_write").agg(F.count("*").alias("n_uses"))


# ------------------------------------------------------------------ XML projects


def _xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: an XML project for each 200 parts: a program, tag and module a part."""
    one = """concat('<Program Name="P', p_partkey, '" MainRoutineName="Main"><Tags><Tag Name="T" DataType="DINT" Dimensions="', p_size % 3, ' 2"/></Tags><Routines><Routine Name="Main" Type="RLL"><RLLContent><Rung Number="9"><Comment><![CDATA[',
      p_type, ']]></Comment><Text><![CDATA[XIC(a', p_partkey, ')OTE(b);]]></Text></Rung></RLLContent></Routine><Routine Name="Seq" Type="ST"><STContent><Line Number="0"><![CDATA[  x := ', p_size, ';]]></Line><Line Number="1"><![CDATA[]]></Line></STContent></Routine></Routines></Program>')"""
    module = """concat('<Module Name="M', p_partkey, '" ParentModule="', CASE p_partkey % 10 WHEN 0 THEN 'Gone' WHEN 1 THEN concat('M', p_partkey + 1) ELSE concat('M', p_partkey - 1) END, '" CatalogNumber="', p_brand, '" Vendor="', p_size % 3, '" Major="', p_size, '" Inhibited="', p_size % 2 = 0,
      '" SafetyNetwork="16#', CASE WHEN p_size % 4 = 0 THEN '0000_0001' ELSE '0000_0000' END, '" ProductType="', CASE WHEN p_size % 8 = 0 THEN 14 ELSE 7 END, '"><Ports><Port Id="1" Address="x" Upstream="false"/><Port Id="2" Address="', p_size, '" Upstream="true"/></Ports></Module>')"""
    p = table(spark, sf_dir, "part").selectExpr("floor(p_partkey / 200) AS k", "p_partkey", f"{one} AS program", f"{module} AS module")
    lists = [F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", c)))[c], "").alias(c) for c in ("program", "module")]
    whole = F.concat(F.lit('<RSLogix5000Content TargetType="Controller"><Controller Name="C">'), F.lit("<Modules>"), "module", F.lit("</Modules><Programs>"), "program", F.lit("</Programs></Controller></RSLogix5000Content>"))
    return by_project(p).groupBy("k").agg(*lists).select(F.concat(F.lit("K"), F.col("k").cast("string")).alias("path"), whole.cast("binary").alias("content"))


@query("""SELECT concat('K', CAST(floor(p_partkey / 200) AS BIGINT)) AS project, concat('P', p_partkey) AS program, routine, n, CASE WHEN routine = 'Main' THEN concat('XIC(a', p_partkey, ')OTE(b);') WHEN n = 0 THEN concat('  x := ', p_size, ';') ELSE '' END AS txt, CASE WHEN routine = 'Main' THEN p_type END AS comment
  FROM part, (SELECT 'Main' AS routine, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'Seq', 0 UNION ALL SELECT 'Seq', 1)""")
def xml_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs and lines of XML projects (S-29, S-30, P-18, W-01)."""
    p = Project(graph.stored(l5x.elements_in(_xml(spark, sf_dir))))
    return p.units.select("project", "program", "routine", "n", "txt", "comment")


@query("""SELECT concat('K', CAST(floor(p_partkey / 200) AS BIGINT)) AS project, concat('M', p_partkey) AS module, CASE p_partkey % 10 WHEN 0 THEN 'Gone' WHEN 1 THEN concat('M', p_partkey + 1) ELSE concat('M', p_partkey - 1) END AS parent, p_brand AS catalog, CASE p_size % 3 WHEN 1 THEN 'Allen-Bradley' ELSE CAST(p_size % 3 AS VARCHAR) END AS vendor,
  concat(p_size, '.0') AS revision, CAST(p_size AS VARCHAR) AS address, p_size % 2 = 0 AS inhibited, p_size % 4 = 0 AND p_size % 8 <> 0 AS safety FROM part""")
def xml_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of XML projects with address, revision and safety (S-31)."""
    return l5x.modules(graph.stored(l5x.elements_in(_xml(spark, sf_dir)))).select("project", "module", "parent", "catalog", "vendor", "revision", "address", "inhibited", "safety")


_THERE = "WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS i, CAST(floor(p_partkey / 200) AS BIGINT) AS k, CAST(p_size AS BIGINT) AS z, p_brand AS b FROM part), "


@query(f"""{_THERE} u AS (SELECT p.*, q.i AS up FROM p LEFT JOIN p q ON q.k = p.k AND q.i = CASE p.i % 10 WHEN 0 THEN -1 WHEN 1 THEN p.i + 1 ELSE p.i - 1 END),
r(i, k, root, level) AS (SELECT i, k, i, 0 FROM u WHERE up IS NULL OR i % 10 = 1 UNION ALL SELECT u.i, u.k, r.root, r.level + 1 FROM r JOIN u ON u.k = r.k AND u.up = r.i WHERE u.i % 10 <> 1)
SELECT concat('K', r.k) AS project, concat(repeat('  ', level), '- **M', r.i, '** — ', b, ' · rev ', z, '.0 · @ ', z, CASE WHEN z % 4 = 0 AND z % 8 <> 0 THEN ' · **safety**' ELSE '' END, CASE WHEN z % 2 = 0 THEN ' · **inhibited**' ELSE '' END) AS line FROM r JOIN p ON p.i = r.i""")
def module_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module tree's page: modules of lost parents are roots, and so is the first of each cycle (K-13, G-06, J-09)."""
    return pages.modules(Project(graph.stored(l5x.elements_in(_xml(spark, sf_dir))))).select("project", "line")


@query("""SELECT p_partkey AS part, p_partkey % 300 + CASE WHEN p_partkey < 300 AND (SELECT min(p_partkey) FROM part) = 1 THEN -1 ELSE 0 END AS level, p_partkey AS last FROM part""")
def deep_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 300 parts: how deep each lies, found by doubling (G-06)."""
    tree = table(spark, sf_dir, "part").selectExpr("p_partkey AS node", "CASE WHEN p_partkey % 300 <> 0 THEN p_partkey - 1 END AS parent", "p_partkey AS ord", "p_partkey AS key")
    return graph.forest(tree).select(F.col("node").alias("part"), long(F.size("path") - 1).alias("level"), F.element_at("path", -1).alias("last"))


# ------------------------------------------------------------------ parameter order


@query("""SELECT concat('A', p_partkey) AS aoi, CASE p_size % 4 WHEN 0 THEN 'ra,d0,rb,d1' WHEN 1 THEN 'd0,rb,ra,d1' WHEN 2 THEN 'd0,d1,ra,rb' ELSE 'rb,ra,d0,d1' END || ',opt' AS params FROM part""")
def parameter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of parameters from an instruction's calls, where none is stored (G-09)."""
    part = table(spark, sf_dir, "part")
    params = "inline(array(named_struct('name', 'ra', 'usage', 'InOut', 'created', 0, 'data_type', 'Ta'), named_struct('name', 'rb', 'usage', 'InOut', 'created', 1, 'data_type', 'Tb'), named_struct('name', 'd1', 'usage', 'Input', 'created', 2, 'data_type', 'DINT'), named_struct('name', 'd0', 'usage', 'Output', 'created', 3, 'data_type', 'DINT'), named_struct('name', 'opt', 'usage', 'Input', 'created', 4, 'data_type', 'BOOL')))"
    members = part.selectExpr("'P' AS project", "concat('A', p_partkey) AS aoi", params).selectExpr("*", "cast(null AS array<int>) AS dims", "true AS parameter", "name <> 'opt' AS required", "true AS visible", "cast(created AS int) AS ord", "false AS ordered")
    layout = part.selectExpr("'P' AS project", "concat('A', p_partkey) AS type_name", "posexplode(array('d0', 'd1', 'opt')) AS (ord, name)").selectExpr("*", "'DINT' AS data_type", "cast(null AS array<int>) AS dims")
    args = "CASE p_size % 4 WHEN 0 THEN 'xa,n,xb,5' WHEN 1 THEN 'n,xb,xa,5' WHEN 2 THEN 'n,m,xa,xb' ELSE 'xb,xa,n,5' END"
    rungs = part.selectExpr("'P' AS project", "'Main' AS program", f"concat('A', p_partkey, '(inst,', {args}, ');') AS txt")
    tags = spark.sql("SELECT 'P' AS project, '' AS scope, inline(array(named_struct('name', 'xa', 'data_type', 'Ta'), named_struct('name', 'xb', 'data_type', 'Tb'), named_struct('name', 'n', 'data_type', 'DINT'), named_struct('name', 'm', 'data_type', 'DINT'))), cast(null AS array<int>) AS dims")
    got = aoi_order.refined(members, layout, rungs, tags)
    return got.groupBy("aoi").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "name")))["name"], ",").alias("params"))
