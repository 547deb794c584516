"""Every query with SQL equals DuckDB's answer on the same tables."""

import glob
import os

import duckdb
import pytest

from rungline import catalog_lookups as catalog
from rungline.catalog import IN, OUT

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SMALL).toPandas()) == rows(duck.sql(catalog.ORACLE[name]).df())


def test_queries_keep_dtypes(spark, duck):
    for name in ("xref_tag", "bypass_counts", "natural_sort"):
        got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), duck.sql(catalog.ORACLE[name]).df()
        assert got[sorted(got.columns)].dtypes.map(str).tolist() == want[sorted(want.columns)].dtypes.map(str).tolist()


def test_paths_from_every_source(spark, duck):
    """A breadth-first search from each source over all lines, 12 hops at most."""
    after = {}
    for src, dst in duck.sql("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem").fetchall():
        after.setdefault(src, set()).add(dst)
    want = set()
    for start in after:
        front = seen = {start}
        for hops in range(13):
            sinks = [(-1000 if n % 50 == 0 else n % 10 - 100, n) for n in front if n % 50 == 0 or n % 11 == 0]
            if sinks:
                want.add((start, min(sinks)[1], hops))
                break
            front = {d for n in front for d in after.get(n, ())} - seen
            seen = seen | front
    got = [tuple(r) for r in catalog.QUERIES["path_to_sink_all"](spark, SMALL).select("start", "sink", "hops").collect()]
    assert sorted(got) == sorted(want) and len(want) > 1000


def test_whole_tables_are_used(spark, duck):
    """Every tag, line and part counts, not those of a subset."""
    tags = duck.sql(f"SELECT count(DISTINCT {IN}) + count(DISTINCT {OUT}) FROM lineitem").fetchall()[0][0]
    assert catalog.QUERIES["xref_all"](spark, SMALL).select("base").distinct().count() == tags
    nodes = duck.sql("SELECT count(*) FROM (SELECT l_orderkey FROM lineitem UNION SELECT l_partkey FROM lineitem)").fetchall()[0][0]
    assert catalog.QUERIES["reachability_all"](spark, SMALL).count() + catalog.QUERIES["orphans_all"](spark, SMALL).count() == nodes
    assert catalog.QUERIES["unproduced_all"](spark, SMALL).count() > 50 and catalog.QUERIES["unconsumed_all"](spark, SMALL).count() > 1000
