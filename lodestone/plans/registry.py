"""All queries and their SQL, collected from the modules of this package and, where it is installed, of ``lodestone.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import corpus, oracle

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [oracle, corpus]


def all_queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
