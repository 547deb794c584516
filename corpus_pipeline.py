"""The corpus pipeline: documents are classified by quality, identified by language, freed of near-duplicates and packed.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame; all but the last return
the columns of documents. run() writes each stage's rows to the shared folder and reads them for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rungline.llm import language, near_dup, packing, quality_model
from rungline.llm.common import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a score under 0.3 go."""
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a letter, or whose best two languages tie or nearly do, go."""
    return language.keep_identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near-duplicates (0.8 on five-word shingles) stays. The 0.85 of the query op10 is its contract alone."""
    return near_dup.keep_first(docs, percent=80, slack=0.18)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces of the remaining documents in sequences of 2048 tokens."""
    return packing.best_two_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [("quality_classifier", good_quality), ("language_id", known_language), ("near_dedup", one_of_each), ("packing", packed)]

#: Nearest-neighbour votes, compressed sizes and sketches are beyond SQL. tests/llm/test_pipeline.py holds each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
