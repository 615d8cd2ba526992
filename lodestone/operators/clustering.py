"""Clustering: average-linkage trees and cuts, k-means over a range of k, the elbow."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.vectors import as_doubles
from lodestone.operators.vectors import centroid_pairs, intra_cosine, size_spread

#: The most rows of one group for which a tree is built; larger groups are refused, not cut.
MAX_TREE_ROWS = 20_000


def average_linkage(x: np.ndarray) -> np.ndarray:
    """Merges (left, right, height, size) of average linkage under cosine distance, by rising height.

    Nearest-neighbour chains over sum vectors: the distance of two clusters of unit vectors is 1 - S_A.S_B / (|A||B|), so
    memory stays with the vectors. Clusters are numbered from n upwards in the order of their merges.
    """
    n = len(x)
    if n < 2:
        return np.zeros((0, 4))
    s = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = s.copy()
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            d = 1 - (s @ s[a]) / (size * size[a])
            d[~alive] = np.inf
            d[a] = np.inf
            if len(chain) > 1:
                d[chain[-2]] -= 1e-12  # among equals the chain turns back, so it ends
            b = int(d.argmin())
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = chain.pop(), chain.pop()
        a, b = min(a, b), max(a, b)
        merges.append((a, b, float(1 - s[a] @ s[b] / (size[a] * size[b]))))
        s[a] += s[b]
        size[a] += size[b]
        alive[b] = False
    order = sorted(range(n - 1), key=lambda i: merges[i][2])
    name, count, out = list(range(n)), [1] * n, []
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for step, i in enumerate(order):
        a, b, h = merges[i]
        ra, rb = find(a), find(b)
        la, lb = name[ra], name[rb]
        root[rb] = ra
        count[ra] += count[rb]
        name[ra] = n + step
        out.append((min(la, lb), max(la, lb), max(h, 0.0), count[ra]))
    return np.array(out)


def cut_height(heights: Sequence[float], last: int = 200, legacy_offset: bool = False) -> float:
    """The height one merge below the largest jump among the ``last`` differences of the (rising) merge heights.

    ``legacy_offset`` keeps the older indexing, which for short trees points too low.
    """
    h = np.asarray(heights, float)
    if len(h) < 2:
        return float(h[0]) if len(h) else 0.0
    jumps = np.diff(h)
    tail = jumps[-last:]
    at = int(tail.argmax())
    g = len(jumps) - last + at if legacy_offset else max(0, len(jumps) - last) + at
    return float(h[max(g - 1, 0)])


def cut_labels(merges: np.ndarray, n: int, height: float | None = None, k: int | None = None) -> np.ndarray:
    """Cluster of each of ``n`` rows: merges below ``height`` applied, or all but the last k - 1. Numbered by first member."""
    root = list(range(n + len(merges)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    take = len(merges) if k is None else max(0, n - k)
    for step, (a, b, h, _) in enumerate(merges[:take]):
        if height is not None and h >= height:
            break
        root[find(int(a))] = n + step
        root[find(int(b))] = n + step
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names)) for i in range(n)])


def _guard(n: int, group: object) -> None:
    if n > MAX_TREE_ROWS:
        raise ValueError(f"group {group!r} has {n} rows; trees are built for {MAX_TREE_ROWS} at most: divide it by k-means first")


def linkage_tree(df: DataFrame, group: str, key: str, vec: str = "embedding") -> DataFrame:
    """``group, step, left, right, height, size`` of each group's tree, rows numbered in key order. Zero vectors are left out."""
    out = T.StructType([df.schema[group], *[T.StructField(c, t) for c, t in (("step", T.IntegerType()), ("left", T.IntegerType()), ("right", T.IntegerType()), ("height", T.DoubleType()), ("size", T.IntegerType()))]])

    def tree(keys, f):
        import pandas as pd

        _guard(len(f), keys[0])
        f = f.sort_values(key)
        m = average_linkage(np.vstack(f[vec].to_numpy()).astype(float))
        return pd.DataFrame({group: [keys[0]] * len(m), "step": range(len(m)), "left": m[:, 0].astype(int), "right": m[:, 1].astype(int), "height": m[:, 2], "size": m[:, 3].astype(int)})

    rows = df.filter(F.col(vec).isNotNull() & F.exists(vec, lambda v: v != 0)).select(group, key, as_doubles(F.col(vec)).alias(vec))
    return rows.groupBy(group).applyInPandas(tree, out)


def context_labels(df: DataFrame, group: str, key: str, vec: str = "embedding", k: int | None = None, height: float | None = None) -> DataFrame:
    """``group, key, label``: each group's tree, cut at ``k`` clusters, at ``height``, or where the heights jump."""
    out = T.StructType([df.schema[group], df.schema[key], T.StructField("label", T.IntegerType())])

    def label(keys, f):
        import pandas as pd

        _guard(len(f), keys[0])
        f = f.sort_values(key)
        m = average_linkage(np.vstack(f[vec].to_numpy()).astype(float))
        cut = height if height is not None or k is not None else cut_height(m[:, 2])
        return pd.DataFrame({group: [keys[0]] * len(f), key: f[key].to_numpy(), "label": cut_labels(m, len(f), cut, k)})

    rows = df.filter(F.col(vec).isNotNull() & F.exists(vec, lambda v: v != 0)).select(group, key, as_doubles(F.col(vec)).alias(vec))
    return rows.groupBy(group).applyInPandas(label, out)


def merge_jumps(tree: DataFrame, group: str, last: int = 50) -> DataFrame:
    """``group, step, height, jump``: the ``last`` differences between neighbouring merge heights, for diagnostics."""
    w = W.partitionBy(group).orderBy("step")
    j = tree.withColumn("jump", F.lead("height").over(w) - F.col("height")).filter("jump is not null")
    return j.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("step")))).filter(F.col("_r") <= last).select(group, "step", "height", "jump")


def main_context(labels: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Rows of each group's most frequent label; ties go to the smaller label."""
    n = labels.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy(F.col(group).alias("_g")).agg(F.max_by(label, F.struct("_n", -F.col(label))).alias("_b"))
    return labels.join(best, (F.col(group) == F.col("_g")) & (F.col(label) == F.col("_b"))).drop("_g", "_b")


def fit_kmeans(df: DataFrame, k: int, vec: str = "embedding", seed: int = 42, starts: int = 3, method: str = "kmeans", out: str = "label"):
    """``df`` with cluster numbers and the model of the lowest cost among ``starts`` seeds; ``method`` kmeans or bisecting.

    A column that is already called ``out`` is replaced.
    """
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    kinds = {"kmeans": KMeans, "bisecting": BisectingKMeans}
    if method not in kinds:
        raise ValueError(f"fit_kmeans: unknown method {method!r}; there are {sorted(kinds)}")
    rows = df.drop(out).withColumn("_v", array_to_vector(as_doubles(F.col(vec))))
    best = min((kinds[method](k=k, seed=seed + i, featuresCol="_v", predictionCol=out).fit(rows) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("_v"), best


def cluster_metrics(df: DataFrame, by: str, k: int, vec: str = "embedding") -> DataFrame:
    """One row: ``avg_intra_cosine`` (weighted by size), ``inter_centroid_cosine``, ``cluster_size_std``."""
    intra = intra_cosine(df, by, vec).agg((F.sum(F.col("n") * F.col("intra")) / F.sum("n")).alias("avg_intra_cosine"))
    inter = centroid_pairs(df, by, vec).agg(F.avg("similarity").alias("inter_centroid_cosine"))
    a, b, c = intra.first(), inter.first(), size_spread(df, by, k).first()
    return df.sparkSession.createDataFrame([(k, a[0], b[0], c[0])], "k int, avg_intra_cosine double, inter_centroid_cosine double, cluster_size_std double")


def probe_k(df: DataFrame, ks: Iterable[int], vec: str = "embedding", features: str | None = None, method: str = "kmeans", seed: int = 42, starts: int = 1) -> DataFrame:
    """``k, method, avg_intra_cosine, inter_centroid_cosine, cluster_size_std`` for each k: fitted on ``features``, measured on ``vec``."""
    df = df.persist()
    try:
        rows = []
        for k in ks:
            labelled, _ = fit_kmeans(df, k, features or vec, seed, starts, method)
            rows.append((k, method, *cluster_metrics(labelled, "label", k, vec).first()[1:]))
    finally:
        df.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, method string, avg_intra_cosine double, inter_centroid_cosine double, cluster_size_std double")


def elbow(curve: DataFrame, x: str = "k", y: str = "inter_centroid_cosine") -> DataFrame:
    """``x, y, distance, selected``: distance of each point of the curve, both axes scaled to 0..1, to the line between its ends.

    The point farthest off is selected, the first of equals. A curve has a row per k, a handful.
    """
    w = W.partitionBy(F.lit(0))
    o = W.partitionBy(F.lit(0)).orderBy(x).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    eps = 1e-9
    s = curve.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x), F.col(y), ((F.col(x) - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + eps)).alias("_x"), ((F.col(y) - F.min(y).over(w)) / (F.max(y).over(w) - F.min(y).over(w) + eps)).alias("_y"))
    s = s.select(x, y, "_x", "_y", *[f("_" + c).over(o).alias(f"_{c}{i}") for c in "xy" for i, f in ((0, F.first), (1, F.last))])
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    d = s.select(x, y, (F.abs(dx * (F.col("_y0") - F.col("_y")) - (F.col("_x0") - F.col("_x")) * dy) / (F.sqrt(dx * dx + dy * dy) + eps)).alias("distance"))
    r = F.row_number().over(w.orderBy(F.desc(F.round("distance", 12)), x))
    return d.select(x, y, "distance", (r == 1).alias("selected"))
