"""Registered queries of the learning-analytics operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, learner_queries, link_queries, retrieval_queries, reward_queries, search_queries, source_queries, text_queries, tutor_queries

_MODULES = (text_queries, link_queries, retrieval_queries, graph_queries, learner_queries, reward_queries, tutor_queries, search_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.REGISTRY.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of every benchmark item over all chunks that have a vector or text in common with it."""
    return retrieval_queries.REGISTRY.queries["hybrid_search"](spark, sf_dir)
