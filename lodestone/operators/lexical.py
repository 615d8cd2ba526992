"""TF-IDF in long form and the term lists made from it; representative selection; phrases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import NEGATORS, STOP_WORDS, term_tokens, with_bigrams
from lodestone.session import durable


@dataclass(frozen=True)
class TfIdf:
    """Parameters of a weighting: idf = ln((1 + n) / (1 + df)) + 1, rows of length 1.

    Terms stay that are in at least ``min_df`` documents and in at most ``max_df`` of them, the ``max_features`` most
    frequent of these, ties by term.
    """

    min_df: int = 1
    max_df: float = 1.0
    max_features: int | None = None
    bigrams: bool = False
    sublinear: bool = False
    pattern: str = r"[\p{L}\p{N}\p{M}_]{2,}"
    stop_words: Sequence[str] = field(default=())

    def tokens(self, x: Column) -> Column:
        t = term_tokens(x, self.pattern, self.stop_words)
        return with_bigrams(t) if self.bigrams else t


def term_counts(docs: DataFrame, key: str, text: str, p: TfIdf, *keep: str) -> DataFrame:
    """``key, *keep, term, tf``."""
    return docs.select(key, *keep, F.explode(p.tokens(F.col(text))).alias("term")).groupBy(key, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n: int, p: TfIdf) -> DataFrame:
    """``term, df, total, idf``."""
    v = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter((F.col("df") >= min(max(p.min_df, 1), max(n, 1))) & (F.col("df") <= p.max_df * n))
    if p.max_features:
        v = v.orderBy(F.desc("total"), "term").limit(p.max_features)
    return v.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def weigh(docs: DataFrame, key: str, text: str, p: TfIdf, *keep: str) -> DataFrame:
    """``key, *keep, term, tf, w``: unit-length TF-IDF rows of all documents, as a relation.

    The vocabulary is broadcast only where ``max_features`` bounds it; otherwise the join is left to the planner.
    """
    n = docs.count()
    counts = term_counts(docs, key, text, p, *keep)
    v = vocabulary(counts, n, p)
    v = F.broadcast(v) if p.max_features else v
    tf = 1 + F.log("tf") if p.sublinear else F.col("tf").cast("double")
    raw = counts.join(v.select("term", "idf"), "term").withColumn("_w", tf * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(key)))
    return raw.select(key, *keep, "term", "tf", (F.col("_w") / length).alias("w"))


def top_terms(scored: DataFrame, by: str, score: str, n: int = 10) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(F.round(score, 9)), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def group_means(weights: DataFrame, docs: DataFrame, by: str) -> DataFrame:
    """``by, term, df, mean``: mean weight of each term over all documents of its group, absent cells counting as 0."""
    sizes = docs.groupBy(F.col(by).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    m = weights.groupBy(by, "term").agg(F.sum("w").alias("_s"), F.count(F.lit(1)).alias("df"))
    return m.join(F.broadcast(sizes), F.col(by) == F.col("_g")).select(by, "term", "df", F.col("_n").alias("n"), (F.col("_s") / F.col("_n")).alias("mean"))


def contrastive_terms(weights: DataFrame, docs: DataFrame, by: str, penalty: float = 0.6, least_share: float = 0.02, n: int = 10) -> DataFrame:
    """Terms by group mean minus ``penalty`` times the mean over all documents, in at least ``least_share`` of the group."""
    total = docs.count()
    overall = weights.groupBy(F.col("term").alias("_t")).agg((F.sum("w") / total).alias("_all"))
    g = group_means(weights, docs, by).filter(F.col("df") >= least_share * F.col("n"))
    return top_terms(g.join(overall, F.col("term") == F.col("_t")).select(by, "term", (F.col("mean") - penalty * F.col("_all")).alias("score")), by, "score", n)


def local_terms(docs: DataFrame, key: str, text: str, by: str, p: TfIdf, share: float = 0.02, least: int = 2, n: int = 10, rank_by: str = "mean") -> DataFrame:
    """Top terms of a weighting fitted in each group by itself: min_df = max(least, int(share * n)) of the group.

    One plan with the group in every key; groups are not collected.
    """
    sizes = docs.groupBy(F.col(by).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    counts = term_counts(docs, key, text, p, by)
    v = counts.groupBy(F.col(by).alias("_b"), F.col("term").alias("_t")).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).join(F.broadcast(sizes), F.col("_b") == F.col("_g"))
    v = v.filter((F.col("df") >= F.greatest(F.lit(least), F.floor(share * F.col("_n")))) & (F.col("df") <= p.max_df * F.col("_n")))
    if p.max_features:
        v = v.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(F.desc("total"), "_t"))).filter(F.col("_r") <= p.max_features)
    v = v.select("_b", "_t", "_n", (F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    tf = 1 + F.log("tf") if p.sublinear else F.col("tf").cast("double")
    raw = counts.join(v, (F.col(by) == F.col("_b")) & (F.col("term") == F.col("_t"))).withColumn("_w", tf * F.col("idf"))
    w = raw.withColumn("w", F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(key))))
    score = F.sum("w") / F.max("_n") if rank_by == "mean" else F.sum("w")
    return top_terms(w.groupBy(by, "term").agg(score.alias("score")), by, "score", n)


def auto_stop_words(docs: DataFrame, key: str, text: str, share: float = 0.25, least_length: int = 3, n: int = 60, probe: int = 3000, pattern: str = "[a-z_]{2,}") -> DataFrame:
    """``term, df, share``: terms in at least ``share`` of the documents, among the ``probe`` most frequent; negators stay terms."""
    total = docs.count()
    v = vocabulary(term_counts(docs, key, text, TfIdf(pattern=pattern)), total, TfIdf(max_features=probe))
    s = F.col("df") / float(max(total, 1))
    return v.filter((s >= share) & (F.length("term") >= least_length) & ~F.col("term").isin(*NEGATORS)).select("term", "df", s.alias("share")).orderBy(F.desc("share"), "term").limit(n)


def centroid_similarity(weights: DataFrame, docs: DataFrame, key: str, by: str) -> DataFrame:
    """``by, key, similarity, rank, n``: each document's cosine to the mean row of its group, ranked; documents without terms get 0.

    The mean row is kept as (group, term); documents meet it by a join on both.
    """
    m = group_means(weights, docs, by).select(F.col(by).alias("_g"), F.col("term").alias("_t"), "mean")
    length = m.groupBy(F.col("_g").alias("_l")).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("_len"))
    s = weights.join(m, (F.col(by) == F.col("_g")) & (F.col("term") == F.col("_t"))).groupBy(by, key).agg(F.sum(F.col("w") * F.col("mean")).alias("_dot"))
    s = s.join(F.broadcast(length), F.col(by) == F.col("_l")).select(F.col(key).alias("_k"), (F.col("_dot") / F.col("_len")).alias("_s"))
    every = docs.select(by, key).join(s, F.col(key) == F.col("_k"), "left").select(by, key, F.coalesce("_s", F.lit(0.0)).alias("similarity"))
    sizes = docs.groupBy(F.col(by).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc(F.round("similarity", 9)), key))
    return every.withColumn("rank", r).join(F.broadcast(sizes), F.col(by) == F.col("_g")).drop("_g")


def row_sums(weights: DataFrame, key: str, by: str) -> DataFrame:
    """``by, key, total, rank``: documents by the sum of their weights, lowest of the best first is left to the caller."""
    s = weights.groupBy(by, key).agg(F.sum("w").alias("total"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(F.round("total", 9)), key)))


def select_closest(ranked: DataFrame, n: int = 15) -> DataFrame:
    return ranked.filter(F.col("rank") <= n)


def select_diverse(ranked: DataFrame, n: int = 15, closest: int = 2, safe_share: float = 0.8) -> DataFrame:
    """Of documents ranked within their group (``rank`` from 1, group size ``n``): the ``closest`` nearest, then one every
    so often through the nearer ``safe_share``; small groups give all of that part.

    The safe part has max(int(safe_share * size), n) documents; the step is max(1, (safe - closest) // (n - closest)).
    """
    r = F.col("rank") - 1
    safe = F.least(F.col("n"), F.greatest(F.floor(F.col("n") * safe_share), F.lit(n))).cast("long")
    step = F.greatest(F.lit(1), F.floor((safe - closest) / (n - closest))).cast("long")
    far = (r >= closest) & ((r - closest) % step == 0) & (F.floor((r - closest) / step) < n - closest)
    return ranked.filter((r < safe) & ((safe <= n) | (r < closest) | far))


def select_diverse_unfloored(ranked: DataFrame, n: int = 10, closest: int = 2, safe_share: float = 0.8) -> DataFrame:
    """The variant whose safe part is int(safe_share * size) and which falls back to the ``n`` nearest when that is less than ``n``."""
    r = F.col("rank") - 1
    safe = F.floor(F.col("n") * safe_share).cast("long")
    step = F.greatest(F.lit(1), F.floor((safe - closest) / (n - closest))).cast("long")
    far = (r >= closest) & ((r - closest) % step == 0) & (F.floor((r - closest) / step) < n - closest)
    return ranked.filter(F.when(safe < n, r < n).otherwise((r < safe) & ((r < closest) | far)))


def rank_phrases(phrases: DataFrame, key: str, phrase: str, n_docs: int, n: int = 10, max_share: float = 0.8) -> DataFrame:
    """``phrase, count, df``: the ``n`` most frequent phrases, of which those in more than ``max_share`` of the documents then go."""
    c = phrases.groupBy(phrase).agg(F.count(F.lit(1)).alias("count"), F.count_distinct(key).alias("df"))
    return c.orderBy(F.desc("count"), phrase).limit(n).filter(F.col("df") <= max_share * n_docs)


def candidate_phrases(x: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Noun-phrase candidates without a tagger: runs of two or more neighbouring words between stop words and marks."""
    bar = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}\p{M}'\s-]+", " | ")
    stop = F.array(*[F.lit(w) for w in stop_words])
    kept = F.transform(F.split(bar, r"\s+"), lambda w: F.when(F.array_contains(stop, w), F.lit("|")).otherwise(w))
    runs = F.transform(F.split(F.array_join(kept, " "), r"(?:\s*\|\s*)+"), lambda p: F.trim(p))
    return F.filter(runs, lambda p: (F.size(F.split(p, " ")) >= 2) & (F.length(p) >= 5))


def shared(df: DataFrame) -> DataFrame:
    """Cut here: several plans read ``df``."""
    return durable(df)
