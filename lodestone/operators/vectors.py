"""Vector operators: centroids, cluster quality from sum vectors, neighbours in blocks, near-duplicate removal, whitening."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.vectors import as_doubles, cosine, dot, norm, unit
from lodestone.schema import require_columns
from lodestone.session import durable

#: Query vectors held by a worker at a time in block operators.
BLOCK_ROWS = 4096


def unit_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    return df.withColumn(vec, unit(F.col(vec)))


def sum_vectors(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """``by, n, sum_vec, sum_sq``: vector sum, count and sum of squared lengths of each group.

    Groups are summed by partial aggregation per dimension, so a group of a third of all rows is no burden; what is
    shuffled is a row per group and dimension from each task.
    """
    require_columns(df, [by, vec], "sum_vectors")
    parts = df.filter(F.col(vec).isNotNull()).select(by, F.posexplode(as_doubles(F.col(vec))).alias("_i", "_x")).groupBy(by, "_i").agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    return parts.groupBy(by).agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias("sum_vec"), F.sum("_q").alias("sum_sq"))


def centroids(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """``by, n, centroid``."""
    return sum_vectors(df, by, vec).select(by, "n", F.transform("sum_vec", lambda x: x / F.col("n")).alias("centroid"))


def intra_cosine(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """``by, n, intra``: mean cosine of the pairs in each group of more than one, from the sum of unit vectors.

    (|S|^2 - sum |u|^2) / (n (n - 1)): no pair is formed.
    """
    s = sum_vectors(unit_vectors(df, vec), by, vec).filter("n > 1")
    return s.select(by, "n", ((dot(F.col("sum_vec"), F.col("sum_vec")) - F.col("sum_sq")) / (F.col("n") * (F.col("n") - 1))).alias("intra"))


def consistency(df: DataFrame, by: str, vec: str = "embedding", more_than: int = 5) -> DataFrame:
    """``by, n, consistency``: mean of the whole cosine matrix, diagonal included, of groups of more than ``more_than``."""
    s = sum_vectors(unit_vectors(df, vec), by, vec).filter(F.col("n") > more_than)
    return s.select(by, "n", (dot(F.col("sum_vec"), F.col("sum_vec")) / (F.col("n") * F.col("n"))).alias("consistency"))


def contextual_variation(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """``by, n, variation``: 1 minus the mean pairwise cosine."""
    return intra_cosine(df, by, vec).select(by, "n", (1 - F.col("intra")).alias("variation"))


def centroid_pairs(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """``i, j, similarity`` of the centroids of each two groups, i < j. Centroids are one per group (a cluster number), few."""
    c = centroids(df, by, vec)
    a = c.select(F.col(by).alias("i"), F.col("centroid").alias("_a"))
    b = c.select(F.col(by).alias("j"), F.col("centroid").alias("_b"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("i", "j", cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def separation(pairs: DataFrame) -> DataFrame:
    """``i, separation``: 1 minus a group's mean similarity to the others."""
    both = pairs.select("i", "similarity").unionAll(pairs.select(F.col("j").alias("i"), "similarity"))
    return both.groupBy("i").agg((1 - F.avg("similarity")).alias("separation"))


def similarity_matrix(pairs: DataFrame) -> DataFrame:
    """One row: the groups in order and the matrix of their similarities, null for fewer than two groups."""
    cells = pairs.unionAll(pairs.select("j", "i", "similarity"))
    diagonal = cells.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("similarity"))
    rows = cells.unionAll(diagonal).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "similarity"))), lambda x: x["similarity"]).alias("row"))
    m = rows.agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("_m"))
    return m.select(F.transform("_m", lambda x: x["i"]).alias("groups"), F.when(F.size("_m") > 1, F.transform("_m", lambda x: x["row"])).alias("matrix"))


def size_spread(df: DataFrame, by: str, k: int) -> DataFrame:
    """Population standard deviation of the sizes of groups 0..k-1, empty ones included."""
    n = df.filter(F.col(by).between(0, k - 1)).groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = n.agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return s.select(F.sqrt(F.greatest(F.lit(0.0), F.coalesce("q", F.lit(0.0)) / k - F.pow(F.coalesce("s", F.lit(0.0)) / k, F.lit(2)))).alias("size_std"))


def size_entropy(df: DataFrame, by: str) -> DataFrame:
    """``entropy`` (nats) of the group sizes, with the smallest and largest size."""
    n = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    t = n.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("l"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    return t.select((F.log("t") - F.col("l") / F.col("t")).alias("entropy"), "smallest", "largest")


def medoids(df: DataFrame, key: str, by: str, vec: str = "embedding", top: int = 10) -> DataFrame:
    """``by, key, rank, distance``: the rows of each group with the lowest mean cosine distance to it, 1 - u.S/n; group -1 is skipped."""
    u = unit_vectors(df.filter(F.col(by) >= 0), vec)
    s = sum_vectors(u, by, vec).select(F.col(by).alias("_g"), "n", "sum_vec")
    scored = u.join(F.broadcast(s), F.col(by) == F.col("_g")).select(by, key, (1 - dot(F.col(vec), F.col("sum_vec")) / F.col("n")).alias("distance"))
    return _ranked(scored, by, [F.round("distance", 9), F.col(key)], top)


def _ranked(df: DataFrame, by: str, order: list[Column], top: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= top)


def closest_to_centroid(df: DataFrame, key: str, by: str, vec: str = "embedding") -> DataFrame:
    """``by, key, similarity, rank, n``: every row's cosine to its group's centroid, ranked within the group."""
    c = centroids(df, by, vec).select(F.col(by).alias("_g"), "n", "centroid")
    scored = df.join(F.broadcast(c), F.col(by) == F.col("_g")).select(by, key, "n", cosine(F.col(vec), F.col("centroid")).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(F.round("similarity", 9)), key)))


def _blocks(queries: DataFrame, key: str, vec: str) -> Iterator[tuple[list, np.ndarray]]:
    keys, rows = [], []
    for r in queries.select(key, vec).filter(F.col(vec).isNotNull()).orderBy(key).toLocalIterator():
        keys.append(r[0])
        rows.append(r[1])
        if len(keys) == BLOCK_ROWS:
            yield keys, np.array(rows, np.float64)
            keys, rows = [], []
    if keys:
        yield keys, np.array(rows, np.float64)


def _normed(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def top_neighbours(df: DataFrame, queries: DataFrame, key: str, vec: str = "embedding", k: int = 5, include_self: bool = False) -> DataFrame:
    """``query, key, similarity, rank``: the ``k`` rows nearest to each query row by cosine; ties go to the smaller key.

    The queries go out in blocks of BLOCK_ROWS vectors; each task keeps its own k best of each query, so a shuffle sees at
    most k rows per query and task. Exact.
    """
    require_columns(df, [key, vec], "top_neighbours")
    spark, kt = df.sparkSession, df.schema[key].dataType.simpleString()
    out = None
    for keys, q in _blocks(queries, key, vec):
        shared = spark.sparkContext.broadcast((keys, _normed(q)))

        def best(frames):
            import pandas as pd

            ks, qs = shared.value
            kept = [[] for _ in ks]
            for f in frames:
                f = f[f[vec].notna()]
                if not len(f):
                    continue
                sims = qs @ _normed(np.vstack(f[vec].to_numpy()).astype(np.float64)).T
                own = f[key].tolist()
                for i, row in enumerate(sims):
                    take = np.argpartition(-row, min(k, len(row) - 1))[: k + 1] if len(row) > k + 1 else np.arange(len(row))
                    kth = np.sort(row[take])[::-1][: k + 1].min()
                    near = [(-round(float(row[j]), 9), own[j]) for j in np.flatnonzero(row >= kth - 1e-9) if include_self or own[j] != ks[i]]
                    kept[i] = sorted(kept[i] + near)[:k]
            rows = [(ks[i], o, -s) for i, near in enumerate(kept) for s, o in near]
            yield pd.DataFrame(rows, columns=["query", key, "similarity"])

        part = df.select(key, vec).mapInPandas(best, f"query {kt}, `{key}` {kt}, similarity double")
        out = part if out is None else out.unionAll(part)
    if out is None:
        return df.limit(0).select(F.col(key).alias("query"), key, F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    return _ranked(out, "query", [F.desc("similarity"), F.col(key)], k)


def similar_links(df: DataFrame, key: str, vec: str = "embedding", threshold: float = 0.985) -> DataFrame:
    """``a, b, similarity``, a < b: all pairs of rows whose cosine is above ``threshold``, exactly.

    All rows go out as queries in blocks and are held against all rows by matrix products; only the links leave a task.
    The work grows with the square of the rows: at scale use a high threshold on rows grouped beforehand.
    """
    require_columns(df, [key, vec], "similar_links")
    spark, kt = df.sparkSession, df.schema[key].dataType.simpleString()
    out = None
    for keys, q in _blocks(df, key, vec):
        shared = spark.sparkContext.broadcast((keys, _normed(q)))

        def links(frames):
            import pandas as pd

            ks, qs = shared.value
            for f in frames:
                f = f[f[vec].notna()]
                if not len(f):
                    continue
                sims = _normed(np.vstack(f[vec].to_numpy()).astype(np.float64)) @ qs.T
                own = f[key].to_numpy()
                i, j = np.nonzero(sims > threshold)
                rows = [(own[x], ks[y], float(sims[x, y])) for x, y in zip(i, j) if own[x] < ks[y]]
                yield pd.DataFrame(rows, columns=["a", "b", "similarity"])

        part = df.select(key, vec).mapInPandas(links, f"a {kt}, b {kt}, similarity double")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else df.limit(0).select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("similarity"))


def link_counts(df: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """``key, links``: how many rows each row is linked to."""
    n = links.select(F.col("a").alias("_k")).unionAll(links.select("b")).groupBy("_k").agg(F.count(F.lit(1)).alias("links"))
    return df.select(key).join(n, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def drop_near_duplicates(df: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """Rows that are in no link: every member of a near-duplicate pair goes."""
    ends = links.select(F.col("a").alias("_k")).unionAll(links.select("b")).distinct()
    return df.join(ends, F.col(key) == F.col("_k"), "left_anti")


def keep_first_near_duplicates(df: DataFrame, key: str, links: DataFrame, rounds: int = 100) -> DataFrame:
    """Greedy removal in key order: a row stays unless it is linked to an earlier row that stays.

    Rounds decide every row without an undecided earlier neighbour, until all are decided; each is cut by a checkpoint.
    """
    e = durable(links.select("a", "b"))
    state = durable(e.select(F.col("a").alias("k")).unionAll(e.select("b")).distinct().select("k", F.lit(0).alias("s")))  # 0 open, 1 stays, 2 goes
    for _ in range(rounds):
        sa = state.select(F.col("k").alias("_a"), F.col("s").alias("_sa"))
        worst = e.join(sa, F.col("a") == F.col("_a")).groupBy("b").agg(F.max((F.col("_sa") == 1).cast("int")).alias("kept"), F.max((F.col("_sa") == 0).cast("int")).alias("open"))
        nxt = state.join(worst, F.col("k") == F.col("b"), "left").select("k", F.when(F.col("s") != 0, F.col("s")).when(F.coalesce("kept", F.lit(0)) == 1, 2).when(F.coalesce("open", F.lit(0)) == 1, 0).otherwise(1).alias("s"))
        state = durable(nxt)
        if state.filter("s = 0").isEmpty():
            break
    return df.join(state.filter("s = 2").select("k"), F.col(key) == F.col("k"), "left_anti")


def silhouette(df: DataFrame, key: str, by: str, vec: str = "embedding") -> DataFrame:
    """``key, by, silhouette``: euclidean silhouette of every row, exact.

    Rows go out as queries in blocks; each task sends the sum of a query's distances to its rows of each cluster, so a
    shuffle sees a row per query, cluster and task. Singletons get 0.
    """
    spark, kt, bt = df.sparkSession, df.schema[key].dataType.simpleString(), df.schema[by].dataType.simpleString()
    rows = df.filter(F.col(by).isNotNull() & F.col(vec).isNotNull())
    sums = None
    for keys, q in _blocks(rows, key, vec):
        shared = spark.sparkContext.broadcast((keys, q))

        def dist(frames):
            import pandas as pd

            ks, qs = shared.value
            acc: dict = {}
            for f in frames:
                for c, g in f.groupby(by):
                    m = np.vstack(g[vec].to_numpy()).astype(np.float64)
                    d = np.sqrt(np.maximum(0, (qs**2).sum(1)[:, None] + (m**2).sum(1)[None, :] - 2 * qs @ m.T)).sum(1)
                    s, n = acc.get(c, (np.zeros(len(ks)), 0))
                    acc[c] = (s + d, n + len(g))
            for c, (s, n) in acc.items():
                yield pd.DataFrame({"_k": ks, "_c": c, "_s": s, "_n": n})

        part = rows.select(by, vec).mapInPandas(dist, f"_k {kt}, _c {bt}, _s double, _n long")
        sums = part if sums is None else sums.unionAll(part)
    if sums is None:
        return df.limit(0).select(key, by, F.lit(0.0).alias("silhouette"))
    t = sums.groupBy("_k", "_c").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    j = t.join(rows.select(key, by), F.col("_k") == F.col(key))
    a = F.max(F.when(F.col("_c") == F.col(by), F.col("_s") / F.greatest(F.col("_n") - 1, F.lit(1))))
    alone = F.max(F.when(F.col("_c") == F.col(by), F.col("_n"))) <= 1
    b = F.min(F.when(F.col("_c") != F.col(by), F.col("_s") / F.col("_n")))
    return j.groupBy(key, by).agg(a.alias("_a"), b.alias("_b"), alone.alias("_one")).select(key, by, F.when(F.col("_one") | F.col("_b").isNull(), 0.0).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b")).alias("silhouette"))


def whiten(df: DataFrame, vec: str = "embedding", k: int = 150, scale: bool = True, out: str = "whitened") -> DataFrame:
    """``df`` with its vectors centred, projected on min(k, n - 1, d) principal components and scaled to variance 1."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(as_doubles(F.col(vec))))
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    k = max(1, min(k, n - 1, d))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(rows).transform(rows)
    pca = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    projected = pca.transform(centred).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")
    if not scale:
        return projected
    std = projected.agg(*[F.stddev_samp(F.col(out)[i]).alias(f"s{i}") for i in range(k)]).first()
    inv = F.array(*[F.lit(1.0 / s if s and s > 1e-12 else 0.0) for s in std])
    return projected.withColumn(out, F.zip_with(out, inv, lambda x, y: x * y))


def mean_of_words(tokens: DataFrame, key: str, words_col: str, vectors: DataFrame, word: str = "word", vec: str = "embedding") -> DataFrame:
    """``key, n, embedding``: mean of the known words' vectors, each occurrence counted; zeros where no word is known."""
    size = vectors.select(F.size(vec)).first()
    dim = size[0] if size else 0
    pairs = tokens.select(key, F.explode(words_col).alias("_w")).join(vectors.select(F.col(word).alias("_v"), F.col(vec).alias("_e")), F.col("_w") == F.col("_v"))
    s = sum_vectors(pairs, key, "_e").select(F.col(key).alias("_k"), "n", F.transform("sum_vec", lambda x: x / F.col("n")).alias("_m"))
    return tokens.select(key).join(s, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("_m", F.array_repeat(F.lit(0.0), dim)).alias("embedding"))
