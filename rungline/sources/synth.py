"""A deterministic project of ladder rungs over the lineitem table, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
PROGRAM = "concat('P', CAST(l_suppkey % 10 AS STRING))"
_BLOCK = "CAST(floor(l_orderkey / 1000) AS BIGINT)"  # routines grow in number with the orders, not in length
ROUTINE = f"concat('R', CAST({_BLOCK} AS STRING))"
IN = "concat('In', CAST(l_partkey % 200 AS STRING))"
OUT = "concat('Out', CAST(l_orderkey % 300 AS STRING))"
TEXT = f"""concat(CASE l_returnflag WHEN 'A' THEN concat('[XIC(', {IN}, '.Ok) ,]') WHEN 'N' THEN concat('[XIC(', {IN}, '.Ok) ,NOP()]')
  ELSE concat('XIC(', {IN}, '.Ok)') END, CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'AFI()' ELSE '' END, 'OTE(', {OUT}, '.Cmd);')"""
NUMBER = f"row_number() OVER (PARTITION BY l_suppkey % 10, {_BLOCK} ORDER BY {COLUMNS}) - 1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows on all cores where its files make fewer partitions than there are cores; larger inputs stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_project(parts: DataFrame, key: str = "k", most: int = 16) -> DataFrame:
    """Rows with the projects in `key`, some `most` projects to a partition and one partition a core at least: a project's rows are few bytes
    and its files many, so by their size the rows of thousands would go to one task."""
    projects = parts.select(key).distinct().count()
    return parts.repartition(max(parts.sparkSession.sparkContext.defaultParallelism, -(-projects // most)), key)


def rungs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """program, routine, n, txt and `more` expressions for each row of lineitem."""
    return spread(table(spark, sf_dir, "lineitem")).selectExpr(f"{PROGRAM} AS program", f"{ROUTINE} AS routine", f"CAST({NUMBER} AS BIGINT) AS n", f"{TEXT} AS txt", *more)


def rungs_sql(*more: str) -> str:
    return f"SELECT {PROGRAM} AS program, {ROUTINE} AS routine, CAST({NUMBER} AS BIGINT) AS n, {TEXT} AS txt{''.join(', ' + m for m in more)} FROM lineitem"
