"""Sinks: the theme document, vectors by model, samples."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(x: Any) -> Any:
    """``x`` with numpy values, rows, sets and tuples as plain JSON values."""
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, dict):
        return {k if isinstance(k, str) else str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    return x


def write_result(result: dict[str, Any], out_dir: str, business_id: str) -> str:
    """Write ``out_dir/business_id/themes.json``, themes in the order of their numbers; returns its path."""
    doc = plain(result)
    themes = doc.get("themes", doc)
    ordered = {k: themes[k] for k in sorted(themes, key=lambda k: (not k.lstrip("-").isdigit(), int(k) if k.lstrip("-").isdigit() else 0, k))}
    doc = doc | {"themes": ordered} if "themes" in doc else ordered
    folder = os.path.join(out_dir, business_id)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "themes.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)
    return path


def write_vectors(vectors: DataFrame, path: str) -> None:
    """``model, vec_id, embedding`` as Parquet, one folder per model."""
    vectors.write.mode("overwrite").partitionBy("model").parquet(path)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones for the same seed whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def assignments_json(assignments: DataFrame) -> DataFrame:
    """Each assignment as a JSON object; null fields are left out."""
    return assignments.select(F.to_json(F.struct(*assignments.columns)).alias("assignment"))
