"""Queries over edits and verdicts, with their SQL: import reports of edited routines and what is wrong with devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import long, query
from .catalog_binary import ORACLE, QUERIES
from .plans.project import Project
from .sinks import imports, routines
from .sources.synth import table

__all__ = ["ORACLE", "QUERIES"]

_NAMED = "CAST(l_suppkey AS STRING)"


@query(f"""SELECT CAST(l_suppkey AS BIGINT) AS supp, 'Zone' || {_NAMED} || '.Ok' AS judged, CAST(CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS consumers,
  CASE l_suppkey % 4 WHEN 0 THEN 'no output is read' WHEN 2 THEN '.Ok bypassed at Safe/R' || {_NAMED} || '#1' WHEN 3 THEN 'reaches no output' ELSE '' END AS problems FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def device_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with the outputs they are judged on: unread, without a sink, or read through a bypassed contact (X-11, A-08, J-18)."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    use = "CASE k % 4 WHEN 0 THEN 'NOP();' WHEN 1 THEN concat('XIC(Zone', k, ')OTE(Mod:SO.Pt);') WHEN 2 THEN concat('[XIC(Zone', k, '.Ok) ,NOP()]OTE(Mod:SO.Pt);') ELSE concat('XIC(Zone', k, '.Ok)OTE(Lamp', k, ');') END"
    units = s.selectExpr("'Safe' AS program", "concat('R', k) AS routine", f"inline(array(named_struct('n', 0, 'txt', concat('Dev(I', k, ',Mod:SI.Pt,Zone', k, ');')), named_struct('n', 1, 'txt', {use})))")
    args = spark.sql("SELECT 'DEV' AS aoi, inline(array(named_struct('ord', 1, 'param', 'In', 'usage', 'Input'), named_struct('ord', 2, 'param', 'Obj', 'usage', 'InOut')))")
    logic = spark.sql("SELECT 'Dev' AS aoi, 'Logic' AS routine, 0 AS n, 'XIC(In)OTE(Obj.Ok);' AS txt")
    p = Project.of(spark, rungs=units.unionByName(logic, allowMissingColumns=True), aoi_args=args, aois=spark.sql("SELECT 'Dev' AS name"), programs=spark.sql("SELECT 'Safe' AS program, true AS safety"))
    d = p.judged_devices
    return d.select(F.substring("routine", 2, 20).cast("long").alias("supp"), F.array_join("judged.operand", ",").alias("judged"), long(F.get("judged", F.lit(0))["consumers"]).alias("consumers"), F.array_join("problems", "; ").alias("problems"))


_HEAD = "'// @program P\n// @routine R', p_partkey, '\n// @type RLL\n\n'"


@query("""SELECT CAST(p_partkey AS BIGINT) AS part, CAST(1 AS BIGINT) AS before, CAST(CASE p_size % 5 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS after, CAST(1 AS BIGINT) AS changed,
  CASE p_size % 5 WHEN 2 THEN '0: unknown instruction FOO' WHEN 3 THEN concat('1: no such routine in the program: Gone', p_partkey) WHEN 4 THEN concat('1: declared nowhere: c', p_partkey) ELSE '' END AS issues,
  CASE p_size % 5 WHEN 1 THEN 'XIC(a)  OTE(b);|NOP();' WHEN 2 THEN 'FOO(a);' WHEN 3 THEN concat('XIC(a)  OTE(b);|JSR(Gone', p_partkey, ');') ELSE concat('XIC(a)  OTE(b);|XIC(c', p_partkey, ') OTE(b);') END AS rungs
  FROM part WHERE p_size % 5 <> 0""")
def edit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited routine files: units before and after, what changed, faults found by validation, and the rungs of the import file (K-15, E-06, V-01)."""
    own = "concat('K', floor(p_partkey / 200))"
    made = lambda body: f"concat({_HEAD}, {body})"
    edited = made("CASE p_size % 5 WHEN 0 THEN '   XIC(a) OTE(b);' WHEN 1 THEN 'XIC(a)OTE(b);\nNOP();' WHEN 2 THEN 'FOO(a);' WHEN 3 THEN concat('XIC(a)OTE(b);\nJSR(Gone', p_partkey, ');') ELSE concat('XIC(a)OTE(b);\nXIC(c', p_partkey, ')OTE(b);') END")
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{own} AS project", "concat('R', p_partkey) AS routine", f"concat({own}, '/Programs/P/R', p_partkey, '.rll') AS file", f"{made(repr('XIC(a) OTE(b);'))} AS was", f"{edited} AS text").withColumns({"program": F.lit("P"), "type": F.lit("RLL"), "aoi": F.lit(None).cast("string")})
    rungs = part.select("project", "program", "aoi", "routine", F.lit(0).cast("long").alias("n"), F.lit("XIC(a)  OTE(b);").alias("txt"), F.lit(None).cast("string").alias("comment"))
    tags = part.select("project").distinct().select("project", F.lit("").alias("scope"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    p = Project.of(spark, rungs=rungs, routines=part.select("project", "program", "aoi", "routine", "type"), tags=tags)
    manifest = part.select(F.col("project").alias("folder"), F.col("project").alias("source"), "file", F.sha1(F.col("was").cast("binary")).alias("hash"), routines.content_hash_of("was").alias("content"), "program", "aoi", "routine", "type", F.lit(True).alias("editable"))
    out = imports.prepared(p, part.select("file", "text"), manifest)
    xml = out.xml.select(F.col("file").alias("target"), F.array_join(F.regexp_extract_all("text", F.lit(r"<Text>\r\n<!\[CDATA\[(.*?)\]\]>"), F.lit(1)), "|").alias("rungs"))
    said = F.array_join(F.transform("issues", lambda i: F.concat(i["n"].cast("string"), F.lit(": "), i["what"])), "; ")
    return out.edits.join(xml, "target", "left").select(F.substring("routine", 2, 20).cast("long").alias("part"), long(F.col("before")).alias("before"), long(F.col("after")).alias("after"), long(F.col("changed")).alias("changed"), said.alias("issues"), "rungs")
