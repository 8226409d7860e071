"""Every query of the catalog operators with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillmart.plans import catalog_queries, curation_queries, detail_queries, index_queries, log_queries, name_queries, result_queries, review_queries
from quillmart.shared import measured_joins

FLAGSHIP = "r2_bm25"


def _measured(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with joins by measured size."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        measured_joins(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**catalog_queries.QUERIES, **log_queries.QUERIES, **result_queries.QUERIES, **review_queries.QUERIES, **index_queries.QUERIES, **name_queries.QUERIES, **curation_queries.QUERIES, **detail_queries.QUERIES}
QUERIES = {name: _measured(f) for name, f in QUERIES.items()}
ORACLE_SQL: dict[str, str] = {**catalog_queries.ORACLE_SQL, **log_queries.ORACLE_SQL, **result_queries.ORACLE_SQL, **review_queries.ORACLE_SQL, **index_queries.ORACLE_SQL, **name_queries.ORACLE_SQL, **curation_queries.ORACLE_SQL, **detail_queries.ORACLE_SQL}
