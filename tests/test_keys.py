"""Queries over binary projects whose parts have the keys of larger tables equal DuckDB's answer."""

import duckdb
import pytest

from rungline import catalog_lookups as catalog

from .conftest import SMALL
from .test_queries import rows


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """A folder with the small table's parts, their keys from `first` on."""

    def make(first: int) -> str:
        folder = tmp_path_factory.mktemp("parts")
        duckdb.sql(f"COPY (SELECT * REPLACE (p_partkey + {first} AS p_partkey) FROM '{SMALL}/part.parquet') TO '{folder}/part.parquet' (FORMAT parquet)")
        return str(folder)

    return make


def same(spark, name: str, folder: str) -> bool:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    return rows(catalog.QUERIES[name](spark, folder).toPandas()) == rows(con.sql(catalog.ORACLE[name]).df())


def test_places_of_modules_have_16_bits(spark, shifted):
    """A third of these keys is 65536 less than others of them."""
    assert same(spark, "acd_modules", shifted(98200))


def test_documents_of_large_keys(spark, shifted):
    """A thousand lines for each of these keys are more than 32 bits count."""
    folder = shifted(4_295_000)
    assert same(spark, "acd_documents", folder) and same(spark, "acd_text_lines", folder)


def test_types_of_large_keys(spark, shifted):
    assert same(spark, "acd_type_members", shifted(4_295_000))
