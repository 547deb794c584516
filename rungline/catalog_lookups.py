"""Queries that look up many things at once, with their SQL: usage with lines in files, meanings of words, the index of cross references."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import long, query
from .catalog_edits import ORACLE, QUERIES
from .plans.project import Project
from .sinks import pages
from .sources.synth import IN, OUT, PROGRAM, rungs, table

__all__ = ["ORACLE", "QUERIES"]

_OWNER, _ROUTINE = "concat('A', CAST(p_size % 5 AS STRING))", "concat('R', CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING))"
_IN, _OUT = "concat('In', CAST(p_size AS STRING))", "concat('Out', CAST(p_partkey % 7 AS STRING))"
_N = f"CAST(row_number() OVER (PARTITION BY {_OWNER}, {_ROUTINE} ORDER BY p_partkey) - 1 AS BIGINT)"
#: A use of each kind for every part.
_REFS = f"r AS (SELECT {_OWNER} AS owner, {_ROUTINE} AS routine, {_N} AS n, {_IN} AS i, {_OUT} AS o FROM part), u AS (SELECT owner, routine, n, i AS name, 'R' AS kind FROM r UNION ALL SELECT owner, routine, n, o, 'W' FROM r)"


def _project(spark: SparkSession, sf_dir: str) -> Project:
    """A rung for each part: it reads a member of one of the program's tags and writes one of the controller's."""
    own = table(spark, sf_dir, "part").selectExpr("'P' AS project", f"{_OWNER} AS program", f"{_ROUTINE} AS routine", f"{_N} AS n", f"concat('XIC(', {_IN}, '.Ok)OTE(', {_OUT}, '.Cmd.Q);') AS txt", f"{_IN} AS i", f"{_OUT} AS o")
    tags = own.select("program", F.col("i").alias("name")).distinct().selectExpr("'P' AS project", "program AS scope", "name", "'TIN' AS data_type").unionByName(own.select("o").distinct().selectExpr("'P' AS project", "'' AS scope", "o AS name", "'TOUT' AS data_type"))
    members = spark.sql("SELECT 'P' AS project, inline(array(named_struct('type_name', 'TIN', 'name', 'Ok', 'data_type', 'BOOL'), named_struct('type_name', 'TOUT', 'name', 'Cmd', 'data_type', 'TCMD'), named_struct('type_name', 'TCMD', 'name', 'Q', 'data_type', 'BOOL')))")
    routines = own.select("project", "program", "routine").distinct().withColumn("type", F.lit("RLL"))
    return Project.of(spark, rungs=own.drop("i", "o"), tags=tags, members=members, routines=routines)


@query(f"""WITH {_REFS} SELECT name AS tag, kind, owner, routine, n, 'P-{hashlib.sha1(b"P").hexdigest()[:8]}/Programs/' || owner || '/' || routine || '.rll' AS file, CAST(5 + 3 * n AS BIGINT) AS line FROM u""")
def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag's writes and reads with the line of the routine's file that the rung's mark is in (X-04, J-23)."""
    p = _project(spark, sf_dir)
    wanted = p.tags.select("project", F.upper("name").alias("tag"), F.nullif("scope", F.lit("")).alias("program"))
    return p.find_usage(wanted).select(F.col("name").alias("tag"), F.when(F.col("is_write"), "W").otherwise("R").alias("kind"), "owner", "routine", long(F.col("n")).alias("n"), "file", long(F.col("line")).alias("line"))


@query(f"""WITH {_REFS}, g AS (SELECT name, owner, routine, string_agg(n, ',' ORDER BY n) AS ns FROM u GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY owner, routine) AS k FROM g),
t AS (SELECT name, string_agg(owner || '/' || routine || ':' || ns, ';' ORDER BY k) FILTER (k <= 6) AS places, CAST(CASE WHEN max(k) > 6 THEN 1 ELSE 0 END AS BIGINT) AS more FROM k GROUP BY name)
SELECT DISTINCT u.owner AS program, u.name || CASE kind WHEN 'R' THEN '.Ok' ELSE '.Cmd.Q' END AS word, u.name AS name, CASE kind WHEN 'R' THEN 'TIN' ELSE 'TOUT' END AS data_type, CASE kind WHEN 'R' THEN 'Ok:BOOL' ELSE 'Cmd:TCMD,Q:BOOL' END AS trail, places, more FROM u JOIN t USING (name)""")
def word_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every word of all rungs means: its tag, type, members below it and first places (X-03, P-23)."""
    m = _project(spark, sf_dir).meanings()
    at = F.array_join(F.concat(*[F.transform(c, lambda x: F.concat(x["owner"], F.lit("/"), x["routine"], F.lit(":"), F.array_join(x["ns"], ","))) for c in ("writes", "reads")]), ";")
    return m.select("program", "word", "name", "data_type", F.array_join(F.transform("trail", lambda x: F.concat(x["name"], F.lit(":"), x["data_type"])), ",").alias("trail"), at.alias("places"), long(F.col("more")).alias("more"))


@query(f"""SELECT '| Scope | Tags referenced | File |' || chr(10) || '|---|---|---|' AS line UNION ALL SELECT concat('| Controller tags | ', count(DISTINCT {IN}), ' | xref/controller.md |') FROM lineitem
UNION ALL SELECT concat('| Program ', {PROGRAM}, ' | ', count(DISTINCT {OUT}), ' | xref/', {PROGRAM}, '.md |') FROM lineitem GROUP BY {PROGRAM}""")
def crossref_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tags of each scope are used: the index of the cross reference (K-07, O-05). Outputs are declared nowhere, so they are their program's."""
    r = rungs(spark, sf_dir)
    tags = table(spark, sf_dir, "lineitem").selectExpr(f"{IN} AS name", "'' AS scope").distinct()
    return pages.cross_reference_index(Project.of(spark, rungs=r, tags=tags)).select("line")
