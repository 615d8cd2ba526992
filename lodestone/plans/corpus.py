"""Corpus queries of the core: several values packed in one field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.packed import delimiter_scores, explode_packed
from lodestone.functions.rows import distinct_rows


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every friend and elite year of each distinct user, with its place."""
    return explode_packed(spark.read.parquet(f"{d}/users.parquet"), "user_id", ["friends", "elite"])


def p3_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """How each candidate delimiter scores for each source of packed fields."""
    one = distinct_rows(spark.read.parquet(f"{d}/users.parquet"), "user_id", ["friends", "elite"])
    fields = one.select(F.explode(F.create_map(F.lit("friends"), F.col("friends"), F.lit("elite"), F.col("elite"))).alias("field_name", "value")).filter("value is not null")
    return delimiter_scores(fields)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_delimiters": p3_delimiters}
SQL: dict[str, str] = {}
