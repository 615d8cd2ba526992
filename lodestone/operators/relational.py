"""Relational operators of the review analytics: look-ups, counts, distributions, theme tables over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.schema import require_columns

#: The most rows of a dimension that is sent to every executor.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, counted before; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def find_businesses(businesses: DataFrame, name: str, contains: bool = False, open_only: bool = True) -> DataFrame:
    """Businesses by name, case and outer spaces aside: equal, or holding ``name`` literally; most reviewed first."""
    require_columns(businesses, ["business_id", "name"], "find_businesses")
    n, v = F.lower(F.trim("name")), name.strip().lower()
    df = businesses.filter(F.contains(n, F.lit(v)) if contains else n == v)
    if open_only and "is_open" in df.columns:
        df = df.filter("is_open = 1")
    return df.orderBy(F.desc_nulls_last("review_count"), "business_id") if "review_count" in df.columns else df.orderBy("business_id")


def top_rows(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def value_counts(df: DataFrame, col: str, n_col: str = "n") -> DataFrame:
    """Frequency of each non-null value."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(n_col))


def mode_of(df: DataFrame, col: str) -> DataFrame:
    """The most frequent value; ties go to the smaller."""
    return value_counts(df, col).orderBy(F.desc("n"), col).limit(1)


def describe(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col).cast("double")
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), q.alias("_q"), F.max(c).alias("high")).select("n", "mean", "std", "low", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "high")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """``bin, n``: equal-width bins from 0, the last one closed; empty bins are left out."""
    c = F.col(col).cast("double")
    low, high = df.agg(F.min(c), F.max(c)).first() or (None, None)
    if low is None:
        return df.limit(0).select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n"))
    width = (high - low) / bins or 1.0
    b = F.least(F.floor((c - low) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return df.filter(c.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def non_null_counts(df: DataFrame) -> DataFrame:
    """``column_name, n``: non-null values of each column, counted in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("column_name", "n"))


def flag_duplicates(df: DataFrame, subset: Sequence[str], out: str = "is_duplicate") -> DataFrame:
    """Mark every row whose values in ``subset`` occur more than once (null equals null).

    Counts are made by a partial aggregation and joined back, so that a value held by a third of all rows does not have
    to be gathered in one task.
    """
    counts = df.groupBy(*[F.col(c).alias(f"_{c}") for c in subset]).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    on = [df[c].eqNullSafe(counts[f"_{c}"]) for c in subset]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(counts, cond, "left").withColumn(out, F.col("_n").isNotNull()).drop("_n", *[f"_{c}" for c in subset])


def keep_first(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """The first row, by ``order``, of each value of ``by``; limited per value before the shuffle."""
    r = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("_r", r).filter("_r = 1").drop("_r")


def join_suffixed(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str], how: str = "left") -> DataFrame:
    """Equi-join in which columns of both sides carry their side's suffix."""
    both = (set(left.columns) & set(right.columns)) - {on}
    for c in both:
        left, right = left.withColumnRenamed(c, c + suffixes[0]), right.withColumnRenamed(c, c + suffixes[1])
    return left.join(right, on, how)


def share_of(df: DataFrame, n: str, by: Sequence[str], out: str = "pct") -> DataFrame:
    """Each row's part of the sum of ``n`` within ``by``, in percent. ``df`` holds counts, so the window sees few rows."""
    return df.withColumn(out, 100.0 * F.col(n) / F.sum(n).over(W.partitionBy(*by)))


def theme_years(assignments: DataFrame, year: Column) -> DataFrame:
    """``year, theme_id, n`` of the assignments with a year and a theme from 0 on."""
    a = assignments.filter("theme_id >= 0").select(year.alias("year"), "theme_id").filter("year is not null")
    return a.groupBy("year", "theme_id").agg(F.count(F.lit(1)).alias("n"))


def pivot_themes(counts: DataFrame, themes: Sequence[int]) -> DataFrame:
    """A row per year and a column per theme, 0 where there is none."""
    return counts.groupBy("year").pivot("theme_id", list(themes)).agg(F.sum("n")).na.fill(0).select("year", *[F.col(str(t)).cast("long").alias(f"theme_{t}") for t in themes])


def zero_cells(counts: DataFrame) -> DataFrame:
    """``theme_id, year`` that have no assignment, among the years and themes that occur (both are small dimensions)."""
    years = counts.agg(F.array_sort(F.collect_set("year")).alias("years"))
    ys = (years.first() or [None])[0] or []
    grid = counts.select("theme_id").distinct().select("theme_id", F.explode(F.array(*[F.lit(y) for y in ys]) if ys else F.array().cast("array<int>")).alias("year"))
    return grid.join(counts.select("theme_id", "year"), ["theme_id", "year"], "left_anti")
