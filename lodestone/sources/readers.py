"""Sources: tables by suffix, filtered review scans, typed JSON lines, saved theme documents, model embeddings."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import RUN_RESULT, USER


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table by its suffix: .parquet, .csv (with header) or .json (one object a line); others raise ``ValueError``."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix == ".parquet":
        return r.parquet(path)
    if suffix == ".csv":
        return r.csv(path, header=True, inferSchema=schema is None)
    if suffix == ".json":
        return r.json(path)
    raise ValueError(f"read_table: no reader for {path!r}; .parquet, .csv and .json are known")


def resolve_path(path: str, root: str) -> str:
    """``path`` itself if it is absolute or a URI, else below ``root``."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(root, path)


def reviews_of(reviews: DataFrame, business_id: object, id_col: str = "business_id") -> DataFrame:
    """One business's reviews; the predicate reaches the Parquet scan."""
    return reviews.filter(F.col(id_col) == F.lit(business_id))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USER).json(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A saved theme document, or its old shape with the themes at the root, as one row of ``RUN_RESULT``."""
    raw = spark.read.text(path, wholetext=True)
    new = F.from_json("value", RUN_RESULT)
    old = F.from_json("value", T.MapType(T.StringType(), RUN_RESULT["themes"].dataType.valueType))
    is_new = F.get_json_object("value", "$.themes").isNotNull()
    empty = F.lit(None)
    return raw.select(
        F.when(is_new, new["metadata"]).alias("metadata"),
        F.when(is_new, new["inter_theme_similarity"]).alias("inter_theme_similarity"),
        F.when(is_new, new["themes"]).otherwise(old).alias("themes"),
        F.when(is_new, new["review_assignments"]).otherwise(empty.cast(RUN_RESULT["review_assignments"].dataType)).alias("review_assignments"),
    )


def result_assignments(result: DataFrame) -> DataFrame:
    return result.select(F.inline("review_assignments"))


def result_themes(result: DataFrame) -> DataFrame:
    return result.select(F.explode("themes").alias("theme_id", "theme")).select(F.col("theme_id").cast("int"), "theme.*")


def read_numpy_vectors(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """``model, vec_id, embedding`` from one .npy matrix per model; files are read where the task runs, in row blocks."""
    import numpy as np

    jobs = []
    for model, path in files.items():
        n = np.load(path, mmap_mode="r").shape[0]
        jobs += [(model, path, s, min(n, s + 10_000)) for s in range(0, n, 10_000)]
    schema = "model string, vec_id long, embedding array<float>"
    if not jobs:
        return spark.createDataFrame([], schema)

    def load(frames):
        import pandas as pd

        for f in frames:
            for model, path, s, e in f.itertuples(index=False):
                m = np.load(path, mmap_mode="r")[s:e].astype("float32")
                yield pd.DataFrame({"model": model, "vec_id": range(s, e), "embedding": list(m)})

    return spark.createDataFrame(jobs, "model string, path string, s long, e long").repartition(len(jobs)).mapInPandas(load, schema)
