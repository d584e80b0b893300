"""All queries of the core, and the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnloom.plans import conversations, corpus, texts

Query = Callable[[SparkSession, str], DataFrame]
_ALL = conversations.QUERIES | texts.QUERIES | corpus.QUERIES


def core_queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def core_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
