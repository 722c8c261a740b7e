"""The registry of queries and of the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phrasewell.plans import corpus_queries, search_queries, text_queries, vector_queries  # noqa: F401  they register their queries
from phrasewell.plans.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q1_dense_search"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
