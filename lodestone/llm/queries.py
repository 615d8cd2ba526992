"""Queries of the training-data operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.rows import distinct_reviews, distinct_rows, spread
from lodestone.llm.clusters import alike_groups, communities, neighbour_graph, shingled, typical_members
from lodestone.llm.language import canonical_language, detect_languages, fit_language_filter
from lodestone.llm.leakage import find_leaks
from lodestone.llm.mixing import counted_documents, mix_report, plan_mix, source_key, source_targets
from lodestone.llm.personal import find_personal, redact
from lodestone.llm.sentences import sentences
from lodestone.llm.toxicity import fit_voter, score_documents
from lodestone.session import durable
from lodestone.llm.terms import distinctive_terms, mark_terms, term_statistics


def _reviews(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return distinct_reviews(spark.read.parquet(f"{d}/reviews.parquet"), *cols)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that at least three places of a review and only a handful of reviews dwell on, among those that mark the review out (z > 0)."""
    z = distinctive_terms(_reviews(spark, d, "lemmas"), "review_id", "lemmas", min_tf=3)
    return z.filter("z > 0 and tf >= 3 and records between 2 and 12").select("review_id", "term")


def p1_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The five most distinctive terms of every review."""
    z = distinctive_terms(_reviews(spark, d, "lemmas"), "review_id", "lemmas")
    rank = F.row_number().over(W.partitionBy("review_id").orderBy(F.desc("z"), "term"))
    return z.withColumn("rank", rank).filter("rank <= 5").select("review_id", "rank", "term", "tf", "records", F.round("z", 6).alias("z"))


def _labelled_reviews(spark: SparkSession, d: str) -> DataFrame:
    """review_id, text, lang: the review's usable label, null if it has none or several that disagree."""
    raw = spark.read.parquet(f"{d}/review_langs.parquet").filter("review_id is not null").select(F.col("review_id").alias("_id"), canonical_language(F.col("lang")).alias("_lang"))
    one = raw.groupBy("_id").agg(F.min("_lang").alias("_a"), F.max("_lang").alias("_b")).select("_id", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("lang"))
    r = _reviews(spark, d, "text")
    return r.join(one, r["review_id"] == one["_id"], "left").drop("_id")


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every distinct review in one language, with its confidence and the review's own label."""
    rows = _labelled_reviews(spark, d)
    model = fit_language_filter(rows, "text", "lang", "review_id")
    return detect_languages(rows.withColumnRenamed("lang", "label"), "review_id", "text", model, ("label",))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The segments of reviews whose label is missing or wrong, or that mix languages."""
    s = p2_segments(spark, d)
    whole = W.partitionBy("review_id")
    case = s.withColumn("_n", F.max("segment_no").over(whole)).withColumn("_l", F.min("lang").over(whole))
    return case.filter("_n > 0 or label is null or label <> _l").select("review_id", "segment_no", "lang")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to tell themes apart."""
    return mark_terms(term_statistics(_reviews(spark, d, "lemmas"), "lemmas")).filter("mark is not null").select("term", "mark")


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences and the number of distinct reviews that hold it."""
    return term_statistics(_reviews(spark, d, "lemmas"), "lemmas").filter("term is not null")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every distinct review."""
    return sentences(_reviews(spark, d, "text_cleaned"), "review_id", "text_cleaned")


def _personal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _reviews(spark, d, "text")
    # the gazetteer: all given names of the writers
    given = spark.read.parquet(f"{d}/users.parquet").select(F.trim("name").alias("name")).filter("length(name) > 1").distinct()
    return r, find_personal(r, "review_id", "text", given)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each different piece of personal data of every distinct review."""
    return _personal(spark, d)[1].select("review_id", "kind", "found").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct review with typed placeholders for its personal data."""
    r, spans = _personal(spark, d)
    return redact(r, "review_id", "text", spans)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of groups of at least three alike reviews, with the group's smallest review_id."""
    r = spread(spark.read.parquet(f"{d}/reviews.parquet").select("review_id", "text_cleaned", "loaded_at"))
    g = alike_groups(r, "review_id", "text_cleaned", F.col("loaded_at"))
    sizes = g.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("review_id").alias("cluster_id")).filter("n >= 3")
    return g.join(sizes.withColumnRenamed("component", "_c"), F.col("component") == F.col("_c")).select("review_id", "cluster_id")


def p7_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Communities of like reviews, which every distinct review is in: size, most typical reviews, prevailing theme."""
    r = spread(spark.read.parquet(f"{d}/reviews.parquet").select("review_id", "text_cleaned", "loaded_at"))
    raw = durable(shingled(r, "review_id", "text_cleaned", F.col("loaded_at"), least_words=0))
    nodes = raw.filter("size(grams) > 0").groupBy("node").agg(F.first("grams").alias("grams"))
    graph = neighbour_graph(nodes, bands=8, rows=1, k=5, rounds=1, least=0.05)
    member = communities(graph)
    one = distinct_rows(raw, "review_id", ["node"], [F.col("_order").asc_nulls_last()])
    of = durable(one.join(member.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("review_id", "node", F.coalesce("community", "node").alias("community")))
    themes = spark.read.parquet(f"{d}/review_assignments.parquet").filter("theme_id >= 0 and review_id is not null").groupBy("review_id").agg(F.min("theme_id").alias("theme_id"))
    votes = of.join(themes, "review_id").groupBy("community", "theme_id").agg(F.count(F.lit(1)).alias("n"))
    theme = votes.groupBy("community").agg(F.max_by("theme_id", F.struct("n", -F.col("theme_id"))).alias("theme_id"))
    name = of.groupBy("node").agg(F.min("review_id").alias("review_id"))
    typical = typical_members(graph, member).join(name, "node").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "review_id"))), lambda x: x["review_id"]).alias("typical_reviews"))
    size = of.groupBy("community").agg(F.count(F.lit(1)).alias("reviews"), F.min("review_id").alias("cluster_id"))
    return size.join(theme, "community", "left").join(typical, "community", "left").select("cluster_id", "reviews", "theme_id", F.coalesce("typical_reviews", F.array("cluster_id")).alias("typical_reviews"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document with an evaluation passage, with the longest tile and how much of the item it covers."""
    docs = _documents(spark, d)
    return find_leaks(docs, "doc_id", "text", spark.read.parquet(f"{d}/eval_items.parquet"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold at least twelve consecutive words of an evaluation item."""
    return p8_leaks(spark, d).select("doc_id", "item_id")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tokens = counted_documents(_documents(spark, d), "doc_id", "text")
    return tokens, source_targets(tokens, spark.read.parquet(f"{d}/source_weights.parquet"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The listed sources that cannot reach their target in the mix, however often their documents may be used."""
    tokens, targets = _mix(spark, d)
    report = mix_report(plan_mix(tokens, "doc_id", targets), targets)
    return report.filter("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document, in order of its place in training, small sources coming later and later."""
    tokens, targets = _mix(spark, d)
    return plan_mix(tokens, "doc_id", targets, {"blog_posts": [(0.0, 0.5), (1.0, 2.0)]}).orderBy("position", "source", "doc_id", "epoch")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each listed source."""
    tokens, targets = _mix(spark, d)
    return mix_report(plan_mix(tokens, "doc_id", targets), targets)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    voter = fit_voter(docs, "doc_id", "text", spark.read.parquet(f"{d}/doc_labels.parquet"), "label")
    return score_documents(docs, "doc_id", "text", voter, ("source",))


#: A document is of a kind from this score on.
P10_THRESHOLD = 0.33


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language."""
    return _scored(spark, d).filter(F.col("score") >= P10_THRESHOLD).select("doc_id", "kind")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document for each kind, with the sentence that speaks for it."""
    return _scored(spark, d)


def p10_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of each kind among the documents of each source."""
    s = _scored(spark, d).withColumn("source", F.coalesce(source_key(F.col("source")), F.lit("")))
    return s.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= P10_THRESHOLD).cast("long")).alias("found"), F.avg((F.col("score") >= P10_THRESHOLD).cast("double")).alias("rate"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_top_terms, p2_found, p2_segments, p4_found, p4_frequencies, p5_found, p6_found, p6_redacted, p7_found, p7_clusters, p8_found, p8_leaks, p9_found, p9_mix, p9_shares, p10_found, p10_scores, p10_source_rates)}
_DISTINCT = "(select * from (select *, row_number() over (partition by review_id order by loaded_at nulls last) as rn from reviews where review_id is not null) where rn = 1)"
_PIECES = rf"(select review_id, unnest(string_split_regex(lemmas, '[\s\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')) as p from {_DISTINCT})"
_TERMS = rf"(select review_id, t as term from (select review_id, regexp_replace(regexp_replace(lower(nfc_normalize(regexp_replace(p, '\p{{Cf}}+', '', 'g'))), '^[^\p{{L}}\p{{N}}\p{{M}}]+', ''), '[^\p{{L}}\p{{N}}\p{{M}}]+$', '') as t from {_PIECES}) where t <> '')"
_STATS = f"(select term, count(*) as occurrences, count(distinct review_id) as records from {_TERMS} group by term)"

SQL: dict[str, str] = {
    "p1_found": f"select t.review_id, t.term from (select review_id, term from {_TERMS} group by all having count(*) >= 3) t join {_STATS} s on s.term = t.term where s.records between 2 and 12",
    "p4_found": f"select term, 'rare' as mark from {_STATS} where records <= 2 union all select term, 'common' from {_STATS} where records > 0.1 * (select count(distinct review_id) from {_TERMS})",
    "p4_frequencies": f"select term, cast(occurrences as bigint) as occurrences, cast(records as bigint) as records from {_STATS}",
    "p9_found": "with d as (select regexp_replace(lower(source), '[\\s_\\-]+', '', 'g') as k, sum(length(text)) as own from documents group by 1), w as (select *, regexp_replace(lower(source), '[\\s_\\-]+', '', 'g') as k from source_weights) select w.source from w left join d on d.k = w.k where coalesce(d.own, 0) * w.max_repeats < w.weight / (select sum(weight) from w) * (select sum(own) from d)",
}
