"""What plans do as tables grow: what they broadcast, how many partitions they make."""

import pytest

from rungline import catalog_lookups as catalog
from rungline.operators import graph
from rungline.sources import projects, synth_acd

from .conftest import SMALL


def test_call_trees_partitions_grow_with_levels(spark):
    """A chain of ten calls: with levels made from all before, each round doubled the partitions."""
    edges = spark.range(10).selectExpr("id AS src", "id + 1 AS dst")
    tree = graph.call_trees(edges, spark.sql("SELECT CAST(0 AS BIGINT) AS node"))
    assert tree.rdd.getNumPartitions() <= 11 * 4 and sorted(r.level for r in tree.collect()) == list(range(11))


def guessed(df) -> list[str]:
    """What a plan broadcasts of checkpoints, whose size is taken for that of the table they were parsed from."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*("))
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for under in lines[k + 1 :]:
                if depth(under) <= depth(line):
                    break
                found += [under] * ("Scan ExistingRDD" in under)
    return found


@pytest.mark.parametrize("name", ["acd_safety_map", "acd_tasks", "acd_ladder", "acd_tags", "acd_text_lines", "module_pages", "acd_parameters", "acd_programs"])
def test_no_guessed_size_is_broadcast(spark, name):
    """What is parsed from a part's project is a thousand times as large as the part's row, so it must not go through the driver as a small table."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert not guessed(catalog.QUERIES[name](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_guessed_size_is_broadcast_to_make_tables(spark, monkeypatch):
    """The tables that Project.of_members keeps on the way, of one project."""
    members, made = graph.kept(synth_acd.members(spark, SMALL)), []
    for name in ("kept", "stored"):
        was = getattr(graph, name, None)
        monkeypatch.setattr(graph, name, lambda df, was=was: (made.append(df), was(df))[1], raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tables = projects.binary_tables(members)
        assert len(made) > 10 and not [x for df in [*made, *tables.values()] for x in guessed(df)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
