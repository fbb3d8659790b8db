"""All registered queries of the tagging engine and their SQL, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus_queries, learning_queries, library_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**learning_queries.QUERIES, **corpus_queries.QUERIES, **library_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**learning_queries.SQL, **corpus_queries.SQL, **library_queries.SQL}
