"""Row-level helpers shared by operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.schema import require_columns


def distinct_rows(df: DataFrame, key: str, cols: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row per non-null ``key`` with only ``key`` and ``cols``.

    Of several rows the first by ``order`` stays, ties broken by a hash of ``cols``, so the choice does not depend on
    partitioning. The window is limited to one row per key before its shuffle, so a key that holds a third of all rows
    sends at most one row per input partition. Rows with a null key are dropped; an empty table gives an empty result.
    """
    require_columns(df, [key, *cols], "distinct_rows")
    w = W.partitionBy(key).orderBy(*order, F.xxhash64(*[F.col(c) for c in cols]))
    kept = df.filter(F.col(key).isNotNull()).select(key, *cols, F.row_number().over(w).alias("_rank_in_key"))
    return kept.filter("_rank_in_key = 1").drop("_rank_in_key")


def distinct_reviews(reviews: DataFrame, *cols: str) -> DataFrame:
    """One row per ``review_id``: the row loaded first (``loaded_at``, where there is such a column)."""
    order = [F.col("loaded_at").asc_nulls_last()] if "loaded_at" in reviews.columns else []
    return distinct_rows(reviews, "review_id", cols, order)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores, for costly work per row on few input files.

    A table of many files stays as it is, without a shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
