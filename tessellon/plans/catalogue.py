"""All registered queries of the library proper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellon.plans import knowledge, retrieval


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*retrieval.QUERIES, *knowledge.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | knowledge.SQL
