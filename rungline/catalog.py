"""Queries over the driver's tables and the SQL that checks them.

Ladder queries parse the rungs of a synthetic project (sources.synth); their SQL computes the answer from the original columns instead, so
it doesn't depend on the parser. Everything counts as BIGINT and lists are joined strings, so that both engines' values compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import paths, rung, st
from .operators import bypass, facts, graph
from .plans.project import Project
from .sinks import routines
from .sources import synth
from .sources.synth import IN, OUT, PROGRAM, ROUTINE, TEXT, rungs, rungs_sql, table
from .streaming import incremental

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def long(c):
    return c.cast("long")


# ------------------------------------------------------------------ parsing and facts


@query("""SELECT name, CAST(count(*) AS BIGINT) AS n_instructions FROM (
  SELECT 'XIC' AS name FROM lineitem UNION ALL SELECT 'OTE' FROM lineitem UNION ALL SELECT 'NOP' FROM lineitem WHERE l_returnflag = 'N'
  UNION ALL SELECT 'AFI' FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1) GROUP BY name""")
def instr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions by mnemonic (P-02)."""
    return facts.instructions(rungs(spark, sf_dir), []).groupBy("name").agg(F.count("*").alias("n_instructions"))


@query(f"""SELECT program, base, is_write, CAST(count(*) AS BIGINT) AS n_uses FROM (
  SELECT {PROGRAM} AS program, {IN} AS base, false AS is_write FROM lineitem UNION ALL SELECT {PROGRAM}, {OUT}, true FROM lineitem) GROUP BY ALL""")
def operand_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes by program and tag (P-07 to P-09)."""
    return facts.operand_uses(rungs(spark, sf_dir), ["program"]).groupBy("program", "base", "is_write").agg(F.count("*").alias("n_uses"))


@query(f"""SELECT program, routine, CASE WHEN w THEN 'write' ELSE 'read' END AS rw, array_to_string(list_sort(list(DISTINCT n)), ',') AS places FROM (
  SELECT program, routine, n, false AS w, l_partkey % 200 = 7 AS hit FROM ({rungs_sql('l_partkey')})
  UNION ALL SELECT program, routine, n, true, l_orderkey % 300 = 7 FROM ({rungs_sql('l_orderkey')})) WHERE hit GROUP BY ALL""")
def xref_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tags In7 and Out7 are read and written (J-01, A-01, X-01); xref_all has every tag."""
    near = rungs(spark, sf_dir).where("txt LIKE '%In7%' OR txt LIKE '%Out7%'")  # a cheap filter that keeps every hit
    uses = facts.operand_uses(near, ["program", "routine", "n"]).where("base IN ('In7', 'Out7')")
    rw = F.when(F.col("is_write"), "write").otherwise("read")
    return uses.groupBy("program", "routine", rw.alias("rw")).agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("places"))


@query(f"""SELECT base, program, routine, CASE WHEN w THEN 'write' ELSE 'read' END AS rw, array_to_string(list_sort(list(DISTINCT n)), ',') AS places FROM (
  SELECT {IN} AS base, program, routine, n, false AS w FROM ({rungs_sql('l_partkey')}) UNION ALL SELECT {OUT}, program, routine, n, true FROM ({rungs_sql('l_orderkey')})) GROUP BY ALL""")
def xref_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every tag is read and written (J-01, A-01, X-01)."""
    uses = facts.operand_uses(rungs(spark, sf_dir), ["program", "routine", "n"])
    rw = F.when(F.col("is_write"), "write").otherwise("read")
    return uses.groupBy("base", "program", "routine", rw.alias("rw")).agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("places"))


@query(f"""SELECT base, CAST(sum(r) AS BIGINT) AS n_reads, CAST(sum(w) AS BIGINT) AS n_writes FROM (
  SELECT {IN} AS base, 1 AS r, 0 AS w FROM lineitem UNION ALL SELECT {OUT}, 0, 1 FROM lineitem) GROUP BY base""")
def ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of each tag (A-02)."""
    return facts.operand_uses(rungs(spark, sf_dir), []).groupBy("base").agg(F.count_if(~F.col("is_write")).alias("n_reads"), F.count_if("is_write").alias("n_writes"))


_PATH = "concat('T', CAST(p_partkey % 40 AS STRING), CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '.Ok' WHEN 2 THEN '[3].Ok' ELSE '.OkToo' END)"
_NORM = _PATH.replace("[3]", "[*]").replace("'T'", "'t'").replace(".OkToo", ".oktoo").replace(".Ok'", ".ok'")


@query(f"""WITH p AS (SELECT DISTINCT CAST(p_partkey % 40 AS BIGINT) AS b, {_NORM} AS k FROM part)
SELECT x.k AS a, y.k AS b FROM p x JOIN p y ON x.b = y.b AND (x.k = y.k OR starts_with(x.k, concat(y.k, '.')) OR starts_with(x.k, concat(y.k, '[')) OR starts_with(y.k, concat(x.k, '.')) OR starts_with(y.k, concat(x.k, '[')))""")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paths of which one holds the other, by the index of prefixes (F-01, F-02, J-02)."""
    p = facts.keyed(table(spark, sf_dir, "part").selectExpr(f"{_PATH} AS operand").withColumn("base", paths.base_tag(F.col("operand"))), F.lit(""))
    return facts.overlap_pairs(p, p).select(F.expr("substring(use_key, 2)").alias("a"), F.expr("substring(other_key, 2)").alias("b"))


# reads use Out(k) where k % 7 isn't 0, so every seventh output is never read
_SOME = "concat(CASE WHEN l_partkey % 7 <> 0 THEN concat('XIC(Out', CAST(l_partkey % 3000 AS STRING), '.Cmd)') ELSE '' END, 'OTE(Out', CAST(l_orderkey % 3000 AS STRING), '.Cmd);')"


def _some(spark, sf_dir):
    units = synth.spread(table(spark, sf_dir, "lineitem")).selectExpr(f"{PROGRAM} AS program", "l_orderkey AS n", f"{_SOME} AS txt")
    return facts.keyed(facts.operand_uses(units, ["program", "n"]), F.lit(""))


@query(f"""WITH t AS (SELECT * FROM lineitem)
SELECT concat('|out', CAST(l_orderkey % 3000 AS STRING), '.cmd') AS use_key, CAST(count(DISTINCT ({PROGRAM}, l_orderkey)) AS BIGINT) AS places FROM t w
WHERE NOT EXISTS (SELECT 1 FROM t r WHERE r.l_partkey % 7 <> 0 AND r.l_partkey % 3000 = w.l_orderkey % 3000) GROUP BY 1""")
def unconsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written signals that nothing reads (J-15, A-06, X-06)."""
    return facts.dangling(_some(spark, sf_dir), True, ["program", "n"]).select("use_key", "places")


@query(f"""WITH t AS (SELECT * FROM lineitem)
SELECT concat('|out', CAST(l_partkey % 3000 AS STRING), '.cmd') AS use_key, CAST(count(DISTINCT ({PROGRAM}, l_orderkey)) AS BIGINT) AS places FROM t r
WHERE r.l_partkey % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM t w WHERE r.l_partkey % 3000 = w.l_orderkey % 3000) GROUP BY 1""")
def unproduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read signals that nothing writes (J-16, X-07)."""
    return facts.dangling(_some(spark, sf_dir), False, ["program", "n"]).select("use_key", "places")


# over every line: outputs are multiples of three, so two of three tags that are read are never written, and tags grow with the tables
_EVERY = "concat(CASE WHEN l_partkey % 7 <> 0 THEN concat('XIC(Out', CAST(l_partkey AS STRING), '.Cmd)') ELSE '' END, 'OTE(Out', CAST(l_orderkey * 3 AS STRING), '.Cmd);')"


def _every(spark, sf_dir):
    units = synth.spread(table(spark, sf_dir, "lineitem")).selectExpr(f"{PROGRAM} AS program", "l_orderkey AS n", f"{_EVERY} AS txt")
    return facts.keyed(facts.operand_uses(units, ["program", "n"]), F.lit(""))


@query(f"""SELECT concat('|out', CAST(l_orderkey * 3 AS STRING), '.cmd') AS use_key, CAST(count(DISTINCT ({PROGRAM}, l_orderkey)) AS BIGINT) AS places FROM lineitem
WHERE l_orderkey * 3 NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 7 <> 0) GROUP BY 1""")
def unconsumed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written signals that nothing reads, over every line (J-15, A-06, X-06)."""
    return facts.dangling(_every(spark, sf_dir), True, ["program", "n"]).select("use_key", "places")


@query(f"""SELECT concat('|out', CAST(l_partkey AS STRING), '.cmd') AS use_key, CAST(count(DISTINCT ({PROGRAM}, l_orderkey)) AS BIGINT) AS places FROM lineitem
WHERE l_partkey % 7 <> 0 AND l_partkey NOT IN (SELECT l_orderkey * 3 FROM lineitem) GROUP BY 1""")
def unproduced_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read signals that nothing writes, over every line (J-16, X-07)."""
    return facts.dangling(_every(spark, sf_dir), False, ["program", "n"]).select("use_key", "places")


@query(f"""SELECT program, scope, CAST(count(*) AS BIGINT) AS n_uses FROM (SELECT {PROGRAM} AS program,
  CASE WHEN l_suppkey % 10 < 5 AND l_partkey % 200 < 100 THEN {PROGRAM} WHEN l_partkey % 200 < 150 THEN '' ELSE '?' END AS scope FROM lineitem) GROUP BY ALL""")
def scope_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program's own tag goes before the controller's; names declared nowhere stay unresolved (J-01, J-23)."""
    local = spark.range(5).crossJoin(spark.range(100).withColumnRenamed("id", "k")).selectExpr("concat('P', id) AS scope", "concat('IN', k) AS name")
    tags = local.unionByName(spark.range(150).selectExpr("'' AS scope", "concat('In', id) AS name"))
    uses = facts.operand_uses(rungs(spark, sf_dir), ["program"]).where("NOT is_write")
    return facts.scoped(uses, tags).groupBy("program", F.coalesce("scope", F.lit("?")).alias("scope")).agg(F.count("*").alias("n_uses"))


_MOVE = "concat('MOV(', CASE l_linenumber WHEN 1 THEN '5' WHEN 2 THEN '16#FF' WHEN 3 THEN '?' ELSE concat('Src', CAST(l_partkey % 9 AS STRING)) END, ',Dst);')"


@query("""SELECT operand, is_write, CAST(count(*) AS BIGINT) AS n_uses FROM (SELECT 'Dst' AS operand, true AS is_write FROM lineitem
  UNION ALL SELECT concat('Src', CAST(l_partkey % 9 AS STRING)), false FROM lineitem WHERE l_linenumber > 3) GROUP BY ALL""")
def literal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals are no tags (P-08)."""
    return facts.operand_uses(synth.spread(table(spark, sf_dir, "lineitem")).selectExpr(f"{_MOVE} AS txt"), []).groupBy("operand", "is_write").agg(F.count("*").alias("n_uses"))


_EXPR = "concat('CPT(D', CAST(l_linenumber AS STRING), ',(A', CAST(l_partkey % 5 AS STRING), '.V + ABS(B[', CAST(l_suppkey % 3 AS STRING), ']) * 16#FF) MOD 7);')"


@query("""SELECT base, is_write, CAST(count(*) AS BIGINT) AS n_uses FROM (SELECT concat('D', CAST(l_linenumber AS STRING)) AS base, true AS is_write FROM lineitem
  UNION ALL SELECT concat('A', CAST(l_partkey % 5 AS STRING)), false FROM lineitem UNION ALL SELECT 'B', false FROM lineitem) GROUP BY ALL""")
def expression_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag of an expression is read; functions and radix literals are none (P-09)."""
    return facts.operand_uses(synth.spread(table(spark, sf_dir, "lineitem")).selectExpr(f"{_EXPR} AS txt"), []).groupBy("base", "is_write").agg(F.count("*").alias("n_uses"))


# ------------------------------------------------------------------ branch tree


@query(f"""SELECT program, kind, CAST(count(*) AS BIGINT) AS n_found FROM (SELECT {PROGRAM} AS program, 'empty-leg' AS kind FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT {PROGRAM}, 'nop-leg' FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT {PROGRAM}, 'afi' FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1) GROUP BY ALL""")
def bypass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bypassed logic by program and kind (P-03, X-05)."""
    return bypass.findings(rungs(spark, sf_dir), ["program"]).groupBy("program", "kind").agg(F.count("*").alias("n_found"))


_LEG = f"CASE l_returnflag WHEN 'A' THEN concat('[XIC(', {IN}, '.Ok),]') WHEN 'N' THEN concat('[XIC(', {IN}, '.Ok),NOP()]') ELSE concat('XIC(', {IN}, '.Ok)') END"


@query(f"""SELECT kind, affected, operands, CAST(count(*) AS BIGINT) AS n_found FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 'empty-leg' ELSE 'nop-leg' END AS kind, concat('[XIC(', {IN}, CASE l_returnflag WHEN 'A' THEN '.Ok) , ]' ELSE '.Ok) ,NOP() ]' END) AS affected, concat({IN}, '.Ok') AS operands FROM lineitem WHERE l_returnflag IN ('A', 'N')
  UNION ALL SELECT 'afi', concat({_LEG}, ' AFI() OTE(', {OUT}, '.Cmd)'), concat({IN}, '.Ok,', {OUT}, '.Cmd') FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1) GROUP BY ALL""")
def bypass_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of bypass shorts or disables, as text and as tags (X-05, P-04, P-05, F-09)."""
    found = bypass.findings(rungs(spark, sf_dir), [])
    return found.groupBy("kind", "affected", F.array_join("operands", ",").alias("operands")).agg(F.count("*").alias("n_found"))


_TWO = "concat(CASE WHEN l_linenumber % 2 = 0 THEN concat('XIC(a', CAST(l_partkey % 3 AS STRING), ')XIO(A', CAST(l_suppkey % 3 AS STRING), ')') ELSE concat('[XIC(a', CAST(l_partkey % 3 AS STRING), ') ,XIO(A', CAST(l_suppkey % 3 AS STRING), ')]') END, 'OTE(Q);')"


@query("""SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'never-true' ELSE 'always-true' END AS kind, lower(concat('a', CAST(l_partkey % 3 AS STRING))) AS operand, CAST(count(*) AS BIGINT) AS n_found
  FROM lineitem WHERE l_partkey % 3 = l_suppkey % 3 GROUP BY ALL""")
def bypass_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contact and its opposite in series, or as the two legs of a branch (X-05)."""
    return bypass.findings(synth.spread(table(spark, sf_dir, "lineitem")).selectExpr(f"{_TWO} AS txt"), []).groupBy("kind", F.lower("operand").alias("operand")).agg(F.count("*").alias("n_found"))


@query(f"SELECT sha1({TEXT}) AS h, CAST(count(*) AS BIGINT) AS n_rungs FROM lineitem GROUP BY 1")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs by a hash that doesn't depend on layout (P-06, E-01). The text gets stray white space first; the one space that the canonical form has before names is taken out again."""
    spaced = F.regexp_replace(F.regexp_replace("txt", r"\)", ")  "), r"\[", " [\n ")
    made = F.regexp_replace(rung.canonical_rung(spaced), r"\) ", ")")
    plain = F.regexp_replace(F.regexp_replace("txt", r"\) ,", "),"), " ", "")
    t = synth.spread(table(spark, sf_dir, "lineitem")).selectExpr(f"{TEXT} AS txt").withColumns({"made": made, "plain": plain})
    return t.groupBy(F.sha1(F.when(F.col("made") == F.col("plain"), F.col("txt")).otherwise("differs")).alias("h")).agg(F.count("*").alias("n_rungs"))


@query("""SELECT doc_id, CAST(opens AS BIGINT) AS opens, CAST(closes AS BIGINT) AS closes FROM (SELECT doc_id, length(text) - length(replace(text, '(', '')) AS opens, length(text) - length(replace(text, ')', '')) AS closes FROM documents)
  WHERE opens + closes > 0""")
def bracket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and closing brackets of texts (P-13), counted without a UDF."""
    count = lambda c: long(F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", count("(").alias("opens"), count(")").alias("closes")).where("opens + closes > 0")


@query("SELECT CAST(count(*) AS BIGINT) AS n_rungs, CAST(0 AS BIGINT) AS n_differ, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS n_laid_out FROM lineitem")
def layout_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laying a rung out changes no rung's canonical form (K-03). A small width makes every rung with a NOP leg long."""
    long_ = "concat(substring_index(txt, 'OTE', 1), CASE WHEN txt LIKE '%NOP%' THEN repeat('XIC(Another.Tag)', 8) ELSE '' END, 'OTE', substring_index(txt, 'OTE', -1))"
    t = rungs(spark, sf_dir).selectExpr(f"{long_} AS txt").withColumn("made", rung.layout_rung("txt"))
    return t.agg(F.count("*").alias("n_rungs"), F.count_if(rung.canonical_rung("made") != rung.canonical_rung("txt")).alias("n_differ"), F.count_if(F.col("made") != F.col("txt")).alias("n_laid_out"))


# ------------------------------------------------------------------ graphs

#: Every line as an edge from its part to its supplier's number, which is a part's number too.
_EDGES = "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem"

#: Every line as an edge between whole keys: nodes and edges grow with the table.
_ALL_EDGES = "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem"


def _edges(spark, sf_dir, edges=_EDGES):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem_edges")
    return spark.sql(edges.replace("lineitem", "lineitem_edges"))


_REACH = f"WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT DISTINCT src FROM e WHERE src < 20 UNION SELECT e.dst FROM r JOIN e ON r.node = e.src)"
_REACH_ALL = _REACH.replace(_EDGES, _ALL_EDGES)


def _reached(e):
    return graph.reachable(e, e.where("src < 20").select(F.col("src").alias("node"))).select("node")


def _unreached(e):
    every = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return every.join(_reached(e), "node", "left_anti")


def _sinks(e, start):
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    sinks = nodes.where("node % 50 = 0 OR node % 11 = 0").selectExpr("node", "CASE WHEN node % 50 = 0 THEN 1000 ELSE 100 - node % 10 END AS rank")
    return graph.nearest_sink(e, start.select(F.col("src").alias("start"), F.col("src").alias("node")), sinks).select("start", "sink", long(F.col("hops")).alias("hops"))


@query(f"{_REACH} SELECT node FROM r")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that calls reach from the seeds (G-01, G-03, X-12)."""
    return _reached(_edges(spark, sf_dir))


@query(f"{_REACH_ALL} SELECT node FROM r")
def reachability_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that calls reach from the seeds, over every line (G-01, G-03, X-12)."""
    return _reached(_edges(spark, sf_dir, _ALL_EDGES))


@query(f"{_REACH} SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT node FROM r)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that no call reaches (G-03, SO-02)."""
    return _unreached(_edges(spark, sf_dir))


@query(f"{_REACH_ALL} SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT node FROM r)")
def orphans_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that no call reaches, over every line (G-03, SO-02)."""
    return _unreached(_edges(spark, sf_dir, _ALL_EDGES))


def _sinks_sql(edges: str) -> str:
    return f"""WITH RECURSIVE e AS ({edges}), a AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
s AS (SELECT node, CASE WHEN node % 50 = 0 THEN 1000 ELSE 100 - node % 10 END AS rank FROM a WHERE node % 50 = 0 OR node % 11 = 0),
d(node, hops) AS (SELECT node, 0 FROM s UNION SELECT e.src, d.hops + 1 FROM d JOIN e ON e.dst = d.node WHERE d.hops < 12),
m AS (SELECT node, min(hops) AS hops FROM d GROUP BY node),
b(node, sink, hops) AS (SELECT node, node, 0 FROM s UNION SELECT m.node, b.sink, m.hops FROM b JOIN e ON e.dst = b.node JOIN m ON m.node = e.src AND m.hops = b.hops + 1),
k AS (SELECT b.node, b.sink, b.hops, row_number() OVER (PARTITION BY b.node ORDER BY s.rank DESC, b.sink) AS r FROM b JOIN s ON s.node = b.sink)
SELECT node AS start, sink, CAST(hops AS BIGINT) AS hops FROM k WHERE r = 1 AND node IN (SELECT src FROM e)"""


@query(_sinks_sql(_EDGES))
def path_to_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-ranked sink at the least number of hops, 12 at most, from every source (G-05)."""
    e = _edges(spark, sf_dir)
    return _sinks(e, e)


@query(_sinks_sql(_ALL_EDGES))
def path_to_sink_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the edges between orders and parts (G-05)."""
    e = _edges(spark, sf_dir, _ALL_EDGES)
    return _sinks(e, e)


@query("""SELECT concat('R', CAST(r_regionkey AS STRING)) AS node, concat('R', CAST(r_regionkey AS STRING)) AS path, CAST(0 AS BIGINT) AS level FROM region
UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), concat('R', CAST(n_regionkey AS STRING), '/N', CAST(n_nationkey AS STRING)), 1 FROM nation
UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), concat('R', CAST(n_regionkey AS STRING), '/N', CAST(n_nationkey AS STRING), '/S', CAST(s_suppkey AS STRING)), 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module tree, parents before children (G-06, J-09)."""
    t = lambda n: table(spark, sf_dir, n)
    tree = t("region").selectExpr("concat('R', r_regionkey) AS node", "cast(null AS string) AS parent").unionByName(t("nation").selectExpr("concat('N', n_nationkey) AS node", "concat('R', n_regionkey) AS parent")).unionByName(t("supplier").selectExpr("concat('S', s_suppkey) AS node", "concat('N', s_nationkey) AS parent"))
    tree = tree.selectExpr("node", "parent", "node AS ord", "node AS key")
    return graph.forest(tree).select("node", F.array_join("path", "/").alias("path"), long(F.size("path") - 1).alias("level"))


# ------------------------------------------------------------------ aggregates, windows and lookups


@query("""SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1""")
def modal_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent kind for each key, ties to the first seen (A-04): two aggregations, no window."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("event_type"))


_AOI = "concat('Dev', CAST(l_suppkey % 5 AS STRING))"


@query(f"""SELECT via, is_write, operand, CAST(count(*) AS BIGINT) AS n_uses FROM (
  SELECT 'instance' AS via, true AS is_write, concat('I', CAST(l_linenumber AS STRING)) AS operand FROM lineitem UNION ALL SELECT 'In', false, concat('A', CAST(l_partkey % 7 AS STRING)) FROM lineitem
  UNION ALL SELECT 'Obj', true, concat('Z', CAST(l_orderkey % 7 AS STRING), '.Ok') FROM lineitem WHERE l_suppkey % 5 < 3 UNION ALL SELECT 'Obj', w, concat('Z', CAST(l_orderkey % 7 AS STRING)) FROM lineitem, (VALUES (true), (false)) v(w) WHERE l_suppkey % 5 >= 3
  UNION ALL SELECT 'Q', true, concat('Q', CAST(l_partkey % 3 AS STRING)) FROM lineitem) GROUP BY ALL""")
def aoi_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of user-defined instructions expand by their signature and by what their logic does with in-out members (P-11, J-04)."""
    text = f"concat({_AOI}, '(I', l_linenumber, ',A', l_partkey % 7, ',Z', l_orderkey % 7, ',Q', l_partkey % 3, ');')"
    args = spark.range(5).selectExpr("concat('DEV', id) AS aoi", "posexplode(array(named_struct('param', 'In', 'usage', 'Input'), named_struct('param', 'Obj', 'usage', 'InOut'), named_struct('param', 'Q', 'usage', 'Output'))) AS (k, s)").selectExpr("aoi", "k + 1 AS ord", "s.param", "s.usage")
    inner = spark.range(3).selectExpr("concat('DEV', id) AS aoi", "'obj' AS param", "'.Ok' AS suffix", "true AS is_write")
    uses = facts.operand_uses(synth.spread(table(spark, sf_dir, "lineitem")).selectExpr(f"{text} AS txt"), [], args, inner)
    return uses.groupBy("via", "is_write", "operand").agg(F.count("*").alias("n_uses"))


@query("""SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, CAST(length(html) - length(regexp_replace(html, '(?s)<script.*?</script>|<!--.*?-->', '', 'g')) AS BIGINT) AS n_blank FROM pages WHERE html IS NOT NULL""")
def blank_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that blanking takes from program text, here scripts and comments of pages (P-14)."""
    cut = F.regexp_replace("html", r"(?s)<script.*?</script>|<!--.*?-->", "")
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", long(F.length("html")).alias("n_chars"), long(F.length("html") - F.length(cut)).alias("n_blank"))


@query("""SELECT base, is_write, line, CAST(count(*) AS BIGINT) AS n_uses FROM (SELECT 'Cnt' AS base, false AS is_write, CAST(1 AS BIGINT) AS line FROM part
  UNION ALL SELECT concat('Q', CAST(p_size % 4 AS STRING)), true, CAST(2 AS BIGINT) FROM part UNION ALL SELECT concat('S', CAST(p_size % 3 AS STRING)), false, CAST(2 AS BIGINT) FROM part) GROUP BY ALL""")
def st_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of Structured Text routines of four lines each (P-14, P-15)."""
    return _st_uses(table(spark, sf_dir, "part"))


@query("""SELECT base, is_write, line, CAST(count(*) AS BIGINT) AS n_uses FROM (SELECT 'Cnt' AS base, false AS is_write, CAST(1 AS BIGINT) AS line FROM part
  UNION ALL SELECT concat('Q', CAST(p_size % 4 AS STRING)), true, CAST(2 AS BIGINT) FROM part UNION ALL SELECT concat('S', CAST(p_size % 3 AS STRING)), false, CAST(2 AS BIGINT) FROM part) GROUP BY ALL""")
def st_uses_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of Structured Text routines, one for every part (P-14, P-15)."""
    return _st_uses(table(spark, sf_dir, "part"))


def _st_uses(parts):
    lines = "array('// set Old := 1;', 'IF Cnt > 5 (* Gone *) THEN', concat('  Q', p_size % 4, ' := S', p_size % 3, ' + 16#FF;'), 'END_IF;')"
    t = parts.selectExpr("p_partkey AS routine", f"posexplode({lines}) AS (n, txt)")
    return st.routine_uses(t, ["routine"]).groupBy("base", "is_write", F.col("n").alias("line")).agg(F.count("*").alias("n_uses"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 17 = 0 THEN 'added' WHEN o_orderkey % 19 = 0 THEN 'removed' WHEN o_orderkey % 13 = 0 THEN 'changed' ELSE 'same' END AS state FROM orders WHERE NOT (o_orderkey % 17 = 0 AND o_orderkey % 19 = 0)""")
def edit_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots compared by content hash with a full outer join (E-01, J-21); the two-level check and the merge of edits (E-02, E-03) are not built."""
    o = table(spark, sf_dir, "orders")
    one = lambda price: F.sha1(F.concat_ws("|", "o_orderkey", "o_orderpriority", price))
    before = o.where("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("key"), one("o_totalprice").alias("h"))
    now = o.where("o_orderkey % 19 <> 0").select(F.col("o_orderkey").alias("key"), one(F.expr("o_totalprice + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END")).alias("h"))
    return incremental.merge_edits(before, now, "key", "h")


@query("SELECT sha1(text) AS h, CAST(count(*) AS BIGINT) AS n_copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that occur more than once (E-01, W-04)."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.sha1("text").alias("h")).agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_id")).where("n_copies > 1")


@query("""SELECT base, CAST(count(*) AS BIGINT) AS n_uses FROM (SELECT concat('In', CAST(l_partkey % 200 AS STRING)) AS base FROM lineitem) u
  WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey <= 150 AND lower(concat('IN', CAST(p_partkey AS STRING))) = lower(base)) GROUP BY base""")
def undefined_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that are used and declared nowhere (V-01, J-17, A-10)."""
    declared = table(spark, sf_dir, "part").where("p_partkey <= 150").selectExpr("lower(concat('IN', p_partkey)) AS name")
    uses = facts.operand_uses(rungs(spark, sf_dir), []).where("NOT is_write")
    return uses.join(declared, F.lower("base") == F.col("name"), "left_anti").groupBy("base").agg(F.count("*").alias("n_uses"))


@query("""SELECT doc_id, md5(CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN concat('"', replace(text, '"', '""'), '"') ELSE text END) AS cell FROM documents WHERE text IS NOT NULL""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as CSV cells, quoted where they must be (K-04)."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(routines.csv_cell(F.col("text"))).alias("cell"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS opened, CAST(epoch_us(max(ts)) + 3600000000 AS BIGINT) AS closed, CAST(count(*) AS BIGINT) AS events FROM s GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events with pauses under an hour (T-02)."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = table(spark, sf_dir, "events")
    base = e.withColumn("at", F.timestamp_micros(F.expr("unix_micros(to_timestamp_ltz(ts))"))) if dict(e.dtypes)["ts"] == "timestamp_ntz" else e.withColumn("at", F.col("ts"))
    shift = F.expr("unix_micros(timestamp '1970-01-01 00:00:00')")
    return incremental.debounced(base, "1 hour", "user_id", "at").select("user_id", (micros("opened") - shift).alias("opened"), (micros("closed") - shift).alias("closed"), "events")


@query("SELECT page_id FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0")
def fingerprint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pages that are new or whose length changed are read again (T-07, E-05)."""
    now = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("length"))
    before = now.where("page_id % 5 <> 0").select("page_id", F.expr("length + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END").alias("length"))
    return incremental.changed(now, before.select(*[F.col(c).alias(c) for c in before.columns]).alias("b").toDF("page_id", "length"), "page_id", "length").select("page_id")


@query("""SELECT conv_id, turn, array_to_string(list(CAST(turn AS STRING)) OVER w, ',') AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) QUALIFY role = 'user'""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three places before and after each hit (W-02, X-02)."""
    near = F.collect_list(F.col("turn").cast("string")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, 3))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_join(near, ",").alias("context")).where("role = 'user'").drop("role")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def consecutive_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal values keep their first (W-03)."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("before", before).where("NOT (event_type <=> before)").select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each key (W-04, S-09)."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT p_type, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS brand FROM part GROUP BY p_type")
def unique_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value where a key has only one (A-05, J-10): least equals greatest, so no set is gathered."""
    return _only_brand(table(spark, sf_dir, "part"))


@query("SELECT p_type, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS brand FROM part GROUP BY p_type")
def unique_or_null_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value where a key has only one, over every part (A-05, J-10)."""
    return _only_brand(table(spark, sf_dir, "part"))


def _only_brand(parts):
    return parts.groupBy("p_type").agg(F.when(F.min("p_brand") == F.max("p_brand"), F.min("p_brand")).alias("brand"))


@query("SELECT concat('C', CAST(s_suppkey AS STRING)) AS name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT) AS place FROM supplier")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 before C10 (O-03)."""
    t = table(spark, sf_dir, "supplier").selectExpr("s_nationkey", "concat('C', s_suppkey) AS name")
    return t.select("name", long(F.row_number().over(Window.partitionBy("s_nationkey").orderBy(paths.natural_key(F.col("name"))))).alias("place"))


@query(r"""SELECT page_id, CAST(k AS BIGINT) AS place, links[k] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages), unnest(range(1, len(links) + 1)) u(k)""")
def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a text as rows with their places (P-02, SO-01)."""
    links = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", links.alias("p", "href")).select("page_id", (long(F.col("p")) + 1).alias("place"), "href")


@query(f"""WITH u AS (SELECT {IN} AS base, concat({PROGRAM}, '/', {ROUTINE}) AS place FROM lineitem), d AS (SELECT DISTINCT base, place FROM u),
k AS (SELECT base, place, row_number() OVER (PARTITION BY base ORDER BY place) AS r FROM d)
SELECT base, string_agg(place, ',' ORDER BY place) FILTER (r <= 6) AS places, CAST(greatest(count(*) - 6, 0) AS BIGINT) AS more FROM k GROUP BY base""")
def first_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six places that read a tag, and how many more there are (O-07)."""
    uses = facts.operand_uses(rungs(spark, sf_dir), ["program", "routine"]).where("NOT is_write")
    placed = uses.select("base", F.concat_ws("/", "program", "routine").alias("place")).distinct()
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("base").orderBy("place")))
    few = ranked.groupBy("base").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 6, F.col("place")))), ",").alias("places"), F.count("*").alias("n"))
    return few.select("base", "places", F.greatest(F.col("n") - 6, F.lit(0)).cast("long").alias("more"))


@query(f"""SELECT program, routine, CAST(count(*) AS BIGINT) AS n_rungs, sha1(string_agg(txt, chr(10) ORDER BY n)) AS h FROM ({rungs_sql()}) GROUP BY ALL""")
def routine_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each routine as one text in rung order (K-02, O-06)."""
    t = rungs(spark, sf_dir).groupBy("program", "routine").agg(F.count("*").alias("n_rungs"), F.array_sort(F.collect_list(F.struct("n", "txt"))).alias("t"))
    return t.select("program", "routine", "n_rungs", F.sha1(F.array_join("t.txt", "\n")).alias("h"))


@query(f"""SELECT program, CAST(count(DISTINCT routine) AS BIGINT) AS n_routines, CAST(count(*) AS BIGINT) AS n_rungs, CAST(count(*) FILTER (a) AS BIGINT) AS n_never FROM
  (SELECT {PROGRAM} AS program, {ROUTINE} AS routine, l_linestatus = 'F' AND l_linenumber = 1 AS a FROM lineitem) GROUP BY program""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a project's summary page (A-03, A-11)."""
    t = table(spark, sf_dir, "lineitem").selectExpr(f"{PROGRAM} AS program", f"{ROUTINE} AS routine", f"{TEXT} AS txt")
    never = facts.instructions(t, ["program"]).where("name = 'AFI'").groupBy("program").agg(F.count("*").alias("n_never"))
    counts = t.groupBy("program").agg(F.count_distinct("routine").alias("n_routines"), F.count("*").alias("n_rungs"))
    return counts.join(never, "program", "left").withColumn("n_never", F.coalesce("n_never", F.lit(0)))


# ------------------------------------------------------------------ a project's own functions, over unit tables

_BROKEN = """concat(CASE l_linenumber % 4 WHEN 0 THEN 'XIC(a)' WHEN 1 THEN 'XIC(a' WHEN 2 THEN '[XIC(a)' ELSE 'XIC(a)]]' END, CASE WHEN l_returnflag = 'R' THEN '' ELSE ';' END)"""


@query("""SELECT problem, CAST(count(*) AS BIGINT) AS n_found FROM (SELECT 'rung must end with ;' AS problem FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'unbalanced ()' FROM lineitem WHERE l_linenumber % 4 = 1
  UNION ALL SELECT 'unbalanced []' FROM lineitem WHERE l_linenumber % 4 IN (2, 3)) GROUP BY problem""")
def rung_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure faults of rungs (P-13)."""
    t = synth.spread(table(spark, sf_dir, "lineitem")).selectExpr(f"{_BROKEN} AS txt")
    return t.select(F.explode(rung.rung_problems("txt")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n_found"))


@query("""SELECT p_partkey, md5(concat('A := ', repeat(' ', CAST(length(p_brand) + 2 AS INT)), ';', repeat(' ', CAST(4 + length(p_type) AS INT)))) AS h FROM part""")
def blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings and comments of program text become spaces (P-14)."""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('A := ', chr(39), p_brand, chr(39), '; // ', p_type) AS txt")
    return t.select("p_partkey", F.md5(st.blank_non_code("txt").cast("binary")).alias("h"))


@query("""SELECT problem, CAST(count(*) AS BIGINT) AS n_found FROM (SELECT 'IF without END_IF' AS problem FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'unbalanced ()' FROM part WHERE p_size % 5 = 0
  UNION ALL SELECT 'unexpected ] in line 2' FROM part WHERE p_size % 7 = 0) GROUP BY problem""")
def st_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without their end and brackets of Structured Text (P-17)."""
    lines = "array('IF a THEN', concat('b := ', CASE WHEN p_size % 5 = 0 THEN '(' ELSE '' END, 'c', CASE WHEN p_size % 7 = 0 THEN ']' ELSE '' END, ';'), CASE WHEN p_size % 3 = 0 THEN '' ELSE 'END_IF;' END)"
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS routine", f"posexplode({lines}) AS (n, txt)")
    return st.routine_problems(t, ["routine"]).groupBy("problem").agg(F.count("*").alias("n_found"))


_UNIT = f"xxhash64({synth.COLUMNS}) AS n"
_LINES = f"(SELECT DISTINCT {synth.COLUMNS} FROM lineitem)"
_CHECKED = """concat('XIC(In', CAST(l_partkey % 200 AS STRING), ')', CASE WHEN l_linenumber = 7 THEN 'FOO(Out)' ELSE '' END, CASE WHEN l_linenumber = 6 THEN concat('JSR(R', CAST(l_orderkey % 100 AS STRING), ')') ELSE '' END, 'OTE(Out);')"""
_CHECKED_ROUTINE = "concat('R', CAST(l_orderkey % 50 AS STRING))"


@query(f"""SELECT kind, program, what, CAST(count(*) AS BIGINT) AS n_found FROM (SELECT 'instruction' AS kind, {PROGRAM} AS program, 'FOO' AS what FROM {_LINES} WHERE l_linenumber = 7
  UNION ALL SELECT 'call', {PROGRAM}, concat('R', CAST(l_orderkey % 100 AS STRING)) FROM {_LINES} WHERE l_linenumber = 6 AND l_orderkey % 100 >= 50
  UNION ALL SELECT DISTINCT 'tag', {PROGRAM}, concat('In', CAST(l_partkey % 200 AS STRING), '/', {_CHECKED_ROUTINE}) FROM lineitem WHERE l_partkey % 200 >= 150) GROUP BY ALL""")
def project_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown instructions, missing routines and undefined tags (V-01, J-17, A-10)."""
    li = table(spark, sf_dir, "lineitem").selectExpr(f"{PROGRAM} AS program", f"{_CHECKED_ROUTINE} AS routine", _UNIT, f"{_CHECKED} AS txt")
    tags = spark.range(150).selectExpr("'' AS scope", "concat('IN', id) AS name").unionByName(spark.sql("SELECT '' AS scope, 'Out' AS name"))
    found = Project.of(spark, rungs=li, tags=tags, routines=li.select("program", "routine").distinct()).issues()
    what = F.when(F.col("kind") == "tag", F.concat_ws("/", "what", "routine")).otherwise(F.col("what"))
    return found.groupBy("kind", "program", what.alias("what")).agg(F.count("*").alias("n_found"))


_MEMBER = """concat('XIC(Dev', CAST(l_partkey % 20 AS STRING), CASE l_linenumber % 3 WHEN 0 THEN '.Ok' WHEN 1 THEN '.Sub.Ok' ELSE '' END, ')COP(Src,Dev', CAST(l_suppkey % 20 AS STRING), CASE WHEN l_returnflag = 'R' THEN '.Sub' ELSE '.OkToo' END, ',1);')"""


@query(f"""SELECT is_write, operand, CAST(count(*) AS BIGINT) AS n_units FROM (SELECT true AS is_write, 'Dev7.Sub' AS operand FROM {_LINES} WHERE l_suppkey % 20 = 7 AND l_returnflag = 'R'
  UNION ALL SELECT false, NULL FROM {_LINES} WHERE l_partkey % 20 = 7 AND l_linenumber % 3 IN (1, 2)) GROUP BY ALL""")
def xref_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross reference of a member: its uses, those inside it and those of what holds it (X-01, F-12)."""
    li = table(spark, sf_dir, "lineitem").selectExpr(f"{PROGRAM} AS program", "'Main' AS routine", _UNIT, f"{_MEMBER} AS txt")
    tags = spark.range(20).selectExpr("'' AS scope", "concat('dev', id) AS name")
    return Project.of(spark, rungs=li, tags=tags).xref("Dev7.Sub.Ok").groupBy("is_write", "operand").agg(F.count("*").alias("n_units"))


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS n_signals FROM (SELECT DISTINCT l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'partial' ELSE 'external' END AS kind FROM lineitem WHERE l_partkey % 2 = 0) GROUP BY kind""")
def safety_unproduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safety signals that are read and never written; some have other members written, some are mapped (X-07, X-10, F-05)."""
    text = "concat('XIC(S', l_partkey, '.Ok)XIC(Mod:SI.Data)', CASE WHEN l_partkey % 2 = 1 THEN concat('OTE(S', l_partkey, ')') WHEN l_partkey % 3 = 0 THEN concat('OTE(S', l_partkey, '.No)') ELSE 'OTE(Lamp)' END, ';')"
    li = table(spark, sf_dir, "lineitem").selectExpr("'Safe' AS program", "'Main' AS routine", _UNIT, f"{text} AS txt")
    p = Project.of(spark, rungs=li, programs=spark.sql("SELECT 'Safe' AS program, true AS safety"), tags=spark.sql("SELECT 'Safe' AS scope, 'Lamp' AS name"))
    return p.unproduced().groupBy("kind").agg(F.count("*").alias("n_signals"))


@query("""SELECT CAST(l_partkey AS BIGINT) AS part, 'Out:O.Data' AS sink, CAST(CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_partkey % 4 END AS BIGINT) AS hops FROM (SELECT DISTINCT l_partkey FROM lineitem) ORDER BY 1""")
def signal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part's first signal over as many rungs as its number modulo four to an output module (G-04, F-04)."""
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    chain = "transform(sequence(0, cast(k % 4 AS int)), i -> named_struct('n', i, 'txt', concat('XIC(', CASE WHEN i = 0 THEN 'Start' ELSE concat('S', k, '.M', i - 1) END, ')OTE(', CASE WHEN i = k % 4 THEN 'Out:O.Data' ELSE concat('S', k, '.M', i) END, ');')))"
    units = parts.selectExpr("'Main' AS program", "concat('R', k) AS routine", f"inline({chain})")
    found = Project.of(spark, rungs=units).paths_to_sinks().where("n = 0")
    return found.select(F.substring("routine", 2, 20).cast("long").alias("part"), "sink", long(F.col("hops")).alias("hops"))


@query("""SELECT CAST(l_suppkey AS BIGINT) AS supp, 'I' || CAST(l_suppkey AS STRING) AS instance, 'Zone' || CAST(l_suppkey AS STRING) || '.Ok' AS output, CAST(CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS consumers, CASE WHEN l_suppkey % 2 = 0 THEN 'Mod:SO.Pt' END AS sink
  FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def safety_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device calls with what their outputs reach (X-08, A-07, J-02)."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    units = s.selectExpr("'Safe' AS program", "concat('R', k) AS routine", "inline(array(named_struct('n', 0, 'txt', concat('Dev(I', k, ',Mod:SI.Pt,Zone', k, ');')), named_struct('n', 1, 'txt', CASE WHEN k % 2 = 0 THEN concat('XIC(Zone', k, ')OTE(Mod:SO.Pt);') ELSE 'NOP();' END)))")
    args = spark.sql("SELECT 'DEV' AS aoi, inline(array(named_struct('ord', 1, 'param', 'In', 'usage', 'Input'), named_struct('ord', 2, 'param', 'Obj', 'usage', 'InOut')))")
    logic = spark.sql("SELECT 'Dev' AS aoi, 'Logic' AS routine, 0 AS n, 'XIC(In)OTE(Obj.Ok);' AS txt")
    p = Project.of(spark, rungs=units.unionByName(logic, allowMissingColumns=True), aoi_args=args, aois=spark.sql("SELECT 'Dev' AS name"), programs=spark.sql("SELECT 'Safe' AS program, true AS safety"))
    d = p.safety_devices().select(F.substring("routine", 2, 20).cast("long").alias("supp"), "instance", F.explode("outputs").alias("o"))
    return d.select("supp", "instance", F.col("o.operand").alias("output"), long(F.col("o.consumers")).alias("consumers"), F.col("o.sink").alias("sink"))


@query("""SELECT path, CAST(level AS BIGINT) AS level FROM (WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey // 2 AS src, s_suppkey AS dst FROM supplier), r(node, path, level) AS (
  SELECT CAST(0 AS BIGINT), '0', 0 UNION ALL SELECT e.dst, concat(r.path, '/', CAST(e.dst AS STRING)), r.level + 1 FROM r JOIN e ON e.src = r.node AND e.dst <> e.src) SELECT * FROM r)""")
def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call path from a main routine (G-01, G-02, X-12)."""
    edges = table(spark, sf_dir, "supplier").selectExpr("s_suppkey DIV 2 AS src", "s_suppkey AS dst")
    tree = graph.call_trees(edges, spark.sql("SELECT CAST(0 AS BIGINT) AS node"))
    return tree.where("NOT recursive").select(F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), long(F.col("level")).alias("level"))


@query("""SELECT found, CAST(count(*) AS BIGINT) AS n_paths FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'BOOL' WHEN 1 THEN 'DINT' WHEN 2 THEN 'INNER' WHEN 3 THEN NULL ELSE 'OUTER' END AS found FROM part) GROUP BY found""")
def path_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type at the end of a member path (P-21, J-12)."""
    path = "concat('T', CASE p_size % 5 WHEN 0 THEN '.In[2].Count.3' WHEN 1 THEN '.In[1].Count' WHEN 2 THEN '.in' WHEN 3 THEN '.In.None' ELSE '' END)"
    p = Project.of(spark)
    p.member_types = spark.sql("SELECT 'P' AS project, inline(array(named_struct('type_name', 'outer', 'member', 'in', 'data_type', 'INNER[4]'), named_struct('type_name', 'inner', 'member', 'count', 'data_type', 'DINT')))")
    o = table(spark, sf_dir, "part").selectExpr("'P' AS project", f"{path} AS operand", "'OUTER' AS type")
    return p.operand_types(o).groupBy("found").agg(F.count("*").alias("n_paths"))


@query("""SELECT o_orderkey AS file, CASE WHEN o_orderkey % 17 = 0 THEN (CASE WHEN o_orderkey % 5 = 1 THEN 'orphan' ELSE 'remove' END) WHEN o_orderkey % 5 = 1 THEN 'keep' WHEN o_orderkey % 5 = 2 AND o_orderkey % 3 <> 0 THEN 'heal'
  WHEN o_orderkey % 3 = 0 THEN 'write' ELSE 'same' END AS action FROM orders""")
def edit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new export does with each routine file: edited ones stay, ones of which only the layout differs are healed (E-02, E-03, K-18)."""
    head = "'// @program P\n// @routine R\n// @type RLL\n\n'"
    made = lambda tag, gap="": f"concat({head}, 'XIC(a', o_orderkey, '){gap}OTE({tag});')"
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS file", f"{made('b')} AS was", f"CASE WHEN o_orderkey % 3 = 0 THEN {made('c')} ELSE {made('b')} END AS now", f"CASE o_orderkey % 5 WHEN 1 THEN {made('hand')} WHEN 2 THEN {made('b', '  ')} ELSE {made('b')} END AS there")
    before = o.select("file", F.sha1(F.col("was").cast("binary")).alias("hash"), routines.content_hash_of("was").alias("content"))
    return routines.merged(before, o.where("file % 17 <> 0").select("file", F.col("now").alias("text")), o.select("file", F.col("there").alias("text"))).select("file", "action")


_XML = """concat('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', nl, '<RSLogix5000Content SchemaRevision="1.0" SoftwareRevision="31.00" TargetName="R', k, '" TargetType="Routine" TargetSubType="RLL" ContainsContext="true" ExportDate="D" ExportOptions="', '{options}', '">', nl,
  '<Controller Use="Context" Name="">', nl, '<Programs Use="Context">', nl, '<Program Use="Context" Name="A&amp;B">', nl, '<Routines Use="Context">', nl, '<Routine Use="Target" Name="R', k, '" Type="RLL">', nl, '<RLLContent>', nl,
  '<Rung Number="0" Type="N">', nl, '<Comment>', nl, '<![CDATA[', c, ']]>', nl, '</Comment>', nl, '<Text>', nl, '<![CDATA[XIC(a)OTE(', k, ');]]>', nl, '</Text>', nl, '</Rung>', nl, '</RLLContent>', nl, '</Routine>', nl, '</Routines>', nl, '</Program>', nl, '</Programs>', nl, '</Controller>', nl, '</RSLogix5000Content>', nl)""".replace("{options}", routines.EXPORT_OPTIONS)


@query(f"SELECT p_partkey, md5({_XML}) AS h FROM (SELECT p_partkey, concat('P', CAST(p_partkey AS STRING)) AS k, p_type AS c, chr(13) || chr(10) AS nl FROM part)")
def import_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routine import files (K-14)."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "'P' AS project", "'A&B' AS program", "concat('RP', p_partkey) AS routine", "'RLL' AS type", "cast(null AS string) AS description", "'' AS controller", "p_type AS comment", "concat('XIC(a)OTE(P', p_partkey, ');') AS txt", "0 AS n")
    xml = routines.import_files(p.select("project", "program", "routine", "type", "description", "controller"), p.select("project", "program", "routine", "n", "txt", "comment"), date="D")
    return xml.select(F.substring("routine", 3, 20).cast("long").alias("p_partkey"), F.md5(F.col("xml").cast("binary")).alias("h"))
