"""The theme pipeline: one business's reviews to labelled themes, and the query that ranks businesses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean_text, word_count
from lodestone.operators.clustering import context_labels, elbow, fit_kmeans, main_context, probe_k
from lodestone.operators.lexical import TfIdf, auto_stop_words, candidate_phrases, centroid_similarity, group_means, rank_phrases, select_diverse, top_terms, weigh
from lodestone.operators.providers import Labeler, TermsLabeler, hashed_embedding, label_theme, lemma_string
from lodestone.operators.vectors import centroid_pairs, similarity_matrix, whiten
from lodestone.schema import require_columns
from lodestone.session import durable
from lodestone.sources.readers import reviews_of


@dataclass(frozen=True)
class Settings:
    k_range: tuple[int, ...] = tuple(range(6, 15))
    min_words: int = 3
    min_main: int = 20
    min_theme: int = 10
    components: int = 150
    starts: int = 1
    tree_rows: int = 20_000
    stop_share: float = 0.25
    seed: int = 42
    weights: TfIdf = field(default_factory=lambda: TfIdf(min_df=15, max_df=0.8, max_features=3000, sublinear=True, pattern="[a-zA-Z_]{2,}"))


def prepare(reviews: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Reviews with ``text_cleaned``, ``lemmas`` and a unit ``embedding``, those of at least ``min_words`` words."""
    require_columns(reviews, ["review_id", "text"], "prepare")
    df = reviews.withColumn("text_cleaned", clean_text(F.col("text")))
    df = df.filter(word_count(F.col("text_cleaned")) >= s.min_words)
    return hashed_embedding(df.withColumn("lemmas", lemma_string(F.col("text_cleaned"), 2)), "text_cleaned")


def run_themes(reviews: DataFrame, business_id: str, business_name: str | None = None, labeler: Labeler | None = None, s: Settings = Settings()) -> dict[str, Any]:
    """Themes of one business as the saved document; {} if there are no reviews or too few in the main context.

    The tree that separates the main context is built for up to ``tree_rows`` reviews; beyond, all reviews are the main
    context and the metadata say so.
    """
    labeler = labeler or TermsLabeler()
    own = durable(prepare(reviews_of(reviews, business_id), s))
    total = own.count()
    if not total:
        return {}
    treed = total <= s.tree_rows
    if treed:
        labels = context_labels(own, "business_id", "review_id")
        main = durable(own.join(main_context(labels, "business_id").select("review_id"), "review_id"))
    else:
        main = own
    n = main.count()
    if n < s.min_main:
        return {}
    white = durable(whiten(main, "embedding", s.components))
    ks = [k for k in s.k_range if k < n]
    curve = probe_k(white, ks, "embedding", "whitened", seed=s.seed, starts=s.starts)
    k = elbow(curve).filter("selected").first()["k"]
    fitted, _ = fit_kmeans(white, k, "whitened", s.seed, s.starts, out="theme_id")
    docs = durable(fitted.select("review_id", "theme_id", "text", "text_cleaned", "lemmas", "embedding", *[c for c in ("date",) if c in fitted.columns]))
    stop = [r["term"] for r in auto_stop_words(docs, "review_id", "lemmas", s.stop_share).collect()]
    tfidf = TfIdf(s.weights.min_df, s.weights.max_df, s.weights.max_features, s.weights.bigrams, s.weights.sublinear, s.weights.pattern, tuple(stop))
    weights = durable(weigh(docs, "review_id", "lemmas", tfidf, "theme_id"))
    terms = top_terms(group_means(weights, docs, "theme_id").filter("mean > 0"), "theme_id", "mean", 10).groupBy("theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    picked = select_diverse(centroid_similarity(weights, docs, "review_id", "theme_id")).join(docs.select("review_id", "text"), "review_id")
    shown = picked.groupBy("theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("examples"))
    sizes = docs.groupBy("theme_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= s.min_theme)
    cards = sizes.join(terms, "theme_id").join(shown, "theme_id", "left").orderBy(F.desc("n"), "theme_id").collect()
    themes: dict[int, dict[str, Any]] = {}
    for c in cards:
        examples = list(c["examples"] or [])
        phrases = []
        if examples:
            ex = docs.sparkSession.createDataFrame(list(enumerate(examples)), "i int, t string").select("i", F.explode(candidate_phrases(F.col("t"))).alias("phrase"))
            phrases = [r["phrase"] for r in rank_phrases(ex, "i", "phrase", len(examples)).collect()]
        try:
            named = label_theme(labeler, c["terms"], phrases, examples)
        except ValueError:
            continue
        themes[c["theme_id"]] = named | {"keywords": list(c["terms"]), "noun_phrases": phrases, "representative_reviews": examples[:10], "review_count": c["n"]}
    kept = docs.filter(F.col("theme_id").isin(list(themes)))
    matrix = similarity_matrix(centroid_pairs(kept, "theme_id")).first() if len(themes) > 1 else None
    meta = {"business_id": business_id, "business_name": business_name, "total_reviews": total, "main_context_reviews": n, "k": k, "theme_ids": sorted(themes)} | ({} if treed else {"context": "all reviews; too many for a tree"})
    rows = docs.select("theme_id", *[F.col(c).cast("string") for c in ("date",) if c in docs.columns], "review_id").orderBy("review_id").toLocalIterator()
    return {"metadata": meta, "inter_theme_similarity": matrix["matrix"] if matrix else None, "themes": themes, "review_assignments": [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]}
