"""Schemas of the domain tables and the column check used by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

COMPLIMENTS = ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos")

USER = T.StructType(
    [T.StructField("user_id", T.StringType(), False), T.StructField("name", T.StringType())]
    + [T.StructField("review_count", T.IntegerType()), T.StructField("yelping_since", T.TimestampType())]
    + [T.StructField(c, T.IntegerType()) for c in ("useful", "funny", "cool")]
    + [T.StructField(c, T.StringType()) for c in ("elite", "friends", "fans")]
    + [T.StructField("average_stars", T.FloatType())]
    + [T.StructField(f"compliment_{c}", T.IntegerType()) for c in COMPLIMENTS]
)

CHECKIN = T.StructType([T.StructField("business_id", T.StringType()), T.StructField("date", T.StringType())])

BUSINESS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("business_id", "name", "address", "city", "state", "postal_code")]
    + [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude", "stars")]
    + [T.StructField(c, T.IntegerType()) for c in ("review_count", "is_open")]
    + [T.StructField(c, T.StringType()) for c in ("categories", "attributes", "hours")]
)

REVIEW = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("review_id", "business_id")]
    + [T.StructField("stars", T.DoubleType()), T.StructField("date", T.TimestampType()), T.StructField("text", T.StringType())]
)

ASSIGNMENT = T.StructType(
    [T.StructField("theme_id", T.IntegerType()), T.StructField("date", T.StringType()), T.StructField("review_id", T.StringType())]
)

THEME = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("theme_name", "theme_category", "summary")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("keywords", "noun_phrases", "representative_reviews")]
    + [T.StructField("review_count", T.LongType())]
)

METADATA = T.StructType(
    [T.StructField("business_id", T.StringType()), T.StructField("business_name", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("total_reviews", "main_context_reviews")]
    + [T.StructField("k", T.IntegerType()), T.StructField("theme_ids", T.ArrayType(T.IntegerType()))]
)

RUN_RESULT = T.StructType(
    [
        T.StructField("metadata", METADATA),
        T.StructField("inter_theme_similarity", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("themes", T.MapType(T.StringType(), THEME)),
        T.StructField("review_assignments", T.ArrayType(ASSIGNMENT)),
    ]
)


def require_columns(df: DataFrame, cols: Iterable[str], op: str) -> None:
    """Raise ``ValueError`` naming the columns that ``op`` needs and ``df`` lacks."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{op}: missing columns {missing}; there are {df.columns}")
