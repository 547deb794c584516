"""What the entry module adds: the ten numbered queries and the pipeline."""

from __future__ import annotations

from . import queries as _queries


def queries() -> dict:
    import corpus_pipeline

    return _queries.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return _queries.ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
