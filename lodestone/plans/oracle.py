"""Reference queries over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.rows import distinct_reviews, spread
from lodestone.operators import clustering as cl
from lodestone.operators import lexical as lx
from lodestone.operators import relational as rel
from lodestone.operators import vectors as ve
from lodestone.sources.readers import reviews_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


BUSINESSES = "(select distinct business_id, name, address, city, state, postal_code, stars, review_count, is_open from businesses)"
_B = ("business_id", "name", "address", "city", "state", "postal_code", "stars", "review_count", "is_open")
REVIEWS = "(select * from (select *, row_number() over (partition by review_id order by loaded_at nulls last) as rn from reviews where review_id is not null) where rn = 1)"


def _businesses(t) -> DataFrame:
    return t("businesses").select(*_B).distinct()


# --- scans, look-ups, relational ---


@query("top_businesses", f"select business_id, name, city, state, review_count from {BUSINESSES} order by review_count desc nulls last, business_id, name, address, city limit 20")
def _(t):
    return rel.top_rows(_businesses(t), "review_count", 20, "business_id", F.col("name").asc_nulls_last(), F.col("address").asc_nulls_last(), F.col("city").asc_nulls_last()).select("business_id", "name", "city", "state", "review_count")


@query("reviews_per_business", f"select r.business_id, min(b.name) as name, count(distinct r.review_id) as reviews from {REVIEWS} r left join businesses b on r.business_id = b.business_id where r.business_id is not null group by r.business_id")
def _(t):
    # reviews are counted before they meet the names
    n = distinct_reviews(t("reviews"), "business_id").filter("business_id is not null").groupBy("business_id").agg(F.count(F.lit(1)).alias("reviews"))
    return n.join(t("businesses").groupBy("business_id").agg(F.min("name").alias("name")), "business_id", "left").select("business_id", "name", "reviews")


@query("business_by_name_exact", f"select business_id, name, review_count from {BUSINESSES} where lower(trim(name)) = 'golden anchor cafe' and is_open = 1")
def _(t):
    return rel.find_businesses(_businesses(t), " Golden Anchor Cafe ").select("business_id", "name", "review_count")


@query("business_by_name_contains", f"select business_id, name, review_count from {BUSINESSES} where contains(lower(trim(name)), '(garden') and is_open = 1")
def _(t):
    return rel.find_businesses(_businesses(t), "(Garden", contains=True).select("business_id", "name", "review_count")


@query("filtered_review_scan", "select review_id, stars from reviews where business_id = (select business_id from reviews where business_id is not null group by business_id order by count(*) desc, business_id limit 1)")
def _(t):
    r = t("reviews")
    top = rel.mode_of(r, "business_id").first()
    return reviews_of(r, top[0] if top else None).select("review_id", "stars")


@query("reviews_left_join_business", "select r.business_id, r.review_id, r.stars as stars_review, b.name, b.stars as stars_business from reviews r left join (select business_id, min(name) as name, min(stars) as stars from businesses group by business_id) b on r.business_id = b.business_id")
def _(t):
    b = t("businesses").groupBy("business_id").agg(F.min("name").alias("name"), F.min("stars").alias("stars"))
    return rel.join_suffixed(t("reviews").select("business_id", "review_id", "stars"), b, "business_id", ("_review", "_business"))


@query("theme_value_counts", "select theme_id, count(*) as n from review_assignments where theme_id is not null group by theme_id")
def _(t):
    return rel.value_counts(t("review_assignments"), "theme_id")


@query("main_theme", "select theme_id, count(*) as n from review_assignments where theme_id is not null group by theme_id order by n desc, theme_id limit 1")
def _(t):
    return rel.mode_of(t("review_assignments"), "theme_id")


@query("state_review_sums", f"select state, cast(sum(review_count) as bigint) as reviews, count(*) as businesses from {BUSINESSES} group by state")
def _(t):
    return _businesses(t).groupBy("state").agg(F.sum("review_count").alias("reviews"), F.count(F.lit(1)).alias("businesses"))


@query("describe_counts", f"select count(review_count) as n, round(avg(review_count), 6) as mean, round(stddev_samp(review_count), 6) as std, cast(min(review_count) as double) as low, quantile_cont(cast(review_count as double), 0.25) as q25, quantile_cont(cast(review_count as double), 0.5) as q50, quantile_cont(cast(review_count as double), 0.75) as q75, cast(max(review_count) as double) as high from {BUSINESSES}")
def _(t):
    return rel.describe(_businesses(t), "review_count").withColumns({"mean": _r("mean"), "std": _r("std")})


@query("histogram_counts", f"with b as (select cast(review_count as double) as x from {BUSINESSES} where review_count is not null), m as (select min(x) as lo, (max(x) - min(x)) / 50 as w from b) select least(cast(floor((x - lo) / case when w = 0 then 1 else w end) as int), 49) as bin, count(*) as n from b, m group by 1")
def _(t):
    return rel.histogram(_businesses(t), "review_count", 50)


@query("distinct_counts", "select count(distinct user_id) as users, count(distinct name) as names, count(distinct fans) as fans from users")
def _(t):
    return t("users").agg(*[F.count_distinct(c).alias(a) for c, a in (("user_id", "users"), ("name", "names"), ("fans", "fans"))])


@query("non_null_counts", "select column_name, n from (unpivot (select count(user_id) as user_id, count(name) as name, count(review_count) as review_count, count(elite) as elite, count(friends) as friends, count(fans) as fans, count(cool) as cool from users) on columns(*) into name column_name value n)")
def _(t):
    return rel.non_null_counts(t("users").select("user_id", "name", "review_count", "elite", "friends", "fans", "cool"))


@query("dup_flag", "select business_id, name, address, count(*) over (partition by name, address) > 1 as is_duplicate from businesses")
def _(t):
    return rel.flag_duplicates(t("businesses").select("business_id", "name", "address"), ["name", "address"])


@query("dedupe_keep_first", "select text, min(review_id) as review_id from reviews where text is not null group by text")
def _(t):
    return rel.keep_first(t("reviews").filter("text is not null").select("text", "review_id"), "text", ["review_id"])


@query("date_range", "select min(date) as first_date, max(date) as last_date from reviews")
def _(t):
    return t("reviews").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("weighted_stars", f"select round(sum(stars * review_count) / sum(review_count), 6) as stars from {BUSINESSES} where stars is not null and review_count is not null")
def _(t):
    return _businesses(t).filter("stars is not null and review_count is not null").agg(_r(F.sum(F.col("stars") * F.col("review_count")) / F.sum("review_count")).alias("stars"))


@query("regex_contains", r"select review_id from reviews where regexp_matches(text, '(?i)\bparking\b') or contains(text, ' - ')")
def _(t):
    return t("reviews").filter(F.col("text").rlike(r"(?i)\bparking\b") | F.contains(F.col("text"), F.lit(" - "))).select("review_id")


@query("checkin_moments", r"select business_id, trim(m) as moment, count(*) as n from (select business_id, unnest(string_split_regex(date, '\s*[,;|]\s*')) as m from (select distinct business_id, date from checkins)) where trim(m) <> '' group by all")
def _(t):
    c = t("checkins").distinct().select("business_id", F.explode(F.split("date", r"\s*[,;|]\s*")).alias("m")).select("business_id", F.trim("m").alias("moment"))
    return c.filter("moment <> ''").groupBy("business_id", "moment").agg(F.count(F.lit(1)).alias("n"))


@query("semi_join_top_themes", "select review_id, theme_id from review_assignments where theme_id in (select theme_id from review_assignments where theme_id >= 0 group by theme_id order by count(*) desc, theme_id limit 3)")
def _(t):
    a = t("review_assignments").select("review_id", "theme_id")
    top = rel.value_counts(a.filter("theme_id >= 0"), "theme_id").orderBy(F.desc("n"), "theme_id").limit(3)
    return a.join(F.broadcast(top.select("theme_id")), "theme_id", "left_semi").select("review_id", "theme_id")


@query("casts", "select business_id, cast(stars as double) as stars, cast(is_open as varchar) as is_open, try_cast(postal_code as int) as postal_number from businesses")
def _(t):
    return t("businesses").select("business_id", F.col("stars").cast("double").alias("stars"), F.col("is_open").cast("string").alias("is_open"), F.col("postal_code").try_cast("int").alias("postal_number"))


# --- themes over time ---

YEAR = r"try_cast(nullif(regexp_extract(coalesce(date, ''), '((?:19|20)\d\d)', 1), '') as int)"
COUNTS = f"(select {YEAR} as year, theme_id, count(*) as n from review_assignments where theme_id >= 0 and {YEAR} is not null group by all)"


def _counts(t) -> DataFrame:
    return rel.theme_years(t("review_assignments"), tx.year_of(F.col("date")))


@query("theme_year_pivot", f"select year, {', '.join(f'cast(coalesce(sum(n) filter (theme_id = {k}), 0) as bigint) as theme_{k}' for k in range(10))} from {COUNTS} group by year")
def _(t):
    return rel.pivot_themes(_counts(t), range(10))


@query("theme_year_share", f"select year, theme_id, n, round(100.0 * n / sum(n) over (partition by year), 6) as pct from {COUNTS}")
def _(t):
    return rel.share_of(_counts(t), "n", ["year"]).withColumn("pct", _r("pct"))


@query("theme_valid_years", f"select year, cast(sum(n) as bigint) as n from {COUNTS} group by year having sum(n) >= 20")
def _(t):
    return _counts(t).groupBy("year").agg(F.sum("n").alias("n")).filter("n >= 20")


@query("theme_zero_years", f"select a.theme_id, y.year from (select distinct theme_id from {COUNTS}) a, (select distinct year from {COUNTS}) y where not exists (select 1 from {COUNTS} c where c.theme_id = a.theme_id and c.year = y.year)")
def _(t):
    return rel.zero_cells(_counts(t))


@query("theme_pct_corpus", "select theme_id, count(*) as n, round_even(100.0 * count(*) / sum(count(*)) over (), 1) as pct from review_assignments where theme_id >= 0 group by theme_id")
def _(t):
    n = rel.value_counts(t("review_assignments").filter("theme_id >= 0"), "theme_id")
    return rel.share_of(n, "n", []).withColumn("pct", F.bround("pct", 1))


@query("theme_timeline", f"with v as (select year from {COUNTS} group by year having sum(n) >= 20), top as (select theme_id from {COUNTS} group by theme_id order by sum(n) desc, theme_id limit 3), s as (select year, theme_id, n, 100.0 * n / sum(n) over (partition by year) as pct from {COUNTS}) select s.year, s.theme_id, s.n, round(s.pct, 6) as pct, s.n < 10 as low_count from s where year in (select year from v) and theme_id in (select theme_id from top)")
def _(t):
    c = _counts(t)
    years = c.groupBy("year").agg(F.sum("n").alias("_t")).filter("_t >= 20").select("year")
    top = c.groupBy("theme_id").agg(F.sum("n").alias("_t")).orderBy(F.desc("_t"), "theme_id").limit(3).select("theme_id")
    s = rel.share_of(c, "n", ["year"]).withColumn("pct", _r("pct"))
    return s.join(F.broadcast(years), "year", "left_semi").join(F.broadcast(top), "theme_id", "left_semi").select("year", "theme_id", "n", "pct", (F.col("n") < 10).alias("low_count"))


@query("theme_names", "select theme_id, count(*) as n, case when theme_id in (0, 1, 2) then case theme_id when 0 then 'service' when 1 then 'food' else 'place' end else 'Theme ' || theme_id end as name from review_assignments where theme_id >= 0 group by theme_id")
def _(t):
    n = rel.value_counts(t("review_assignments").filter("theme_id >= 0"), "theme_id")
    names = F.create_map(*[F.lit(x) for kv in {0: "service", 1: "food", 2: "place"}.items() for x in kv])
    return n.withColumn("name", F.coalesce(F.try_element_at(names, F.col("theme_id")), F.concat(F.lit("Theme "), F.col("theme_id").cast("string"))))


@query("review_assignments", "select review_id, '{' || '\"theme_id\":' || theme_id || case when date is null then '' else ',\"date\":\"' || date || '\"' end || case when review_id is null then '' else ',\"review_id\":\"' || review_id || '\"' end || '}' as assignment from review_assignments where theme_id >= 0")
def _(t):
    a = t("review_assignments").filter("theme_id >= 0")
    return a.select("review_id", F.to_json(F.struct("theme_id", "date", "review_id")).alias("assignment"))


# --- text ---


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_replace(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {_sql_lit(pattern)}, {_sql_lit(to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"


def sql_strip_html(x: str) -> str:
    for tag in tx.DROPPED_ELEMENTS:
        x = _sql_replace(x, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    x = _sql_replace(_sql_replace(x, r"(?s)<!--.*?-->", " "), r"(?s)<[a-zA-Z/!][^>]*>", " ")
    for k, v in tx.ENTITIES.items():
        x = f"replace({x}, {_sql_lit(k)}, {_sql_lit(v)})"
    return x


def sql_collapse(x: str) -> str:
    return f"trim({_sql_replace(x, tx.SPACE, ' ')})"


def sql_clean(x: str) -> str:
    x = _sql_replace(_sql_replace(sql_strip_html(f"coalesce({x}, 'None')"), tx.URL, ""), r"\r\n?|\n", " ")
    for pattern, full in tx.CONTRACTIONS:
        x = _sql_replace(x, pattern, full)
    x = f"translate({x}, {_sql_lit(tx.ACCENTED)}, {_sql_lit(tx.PLAIN)})"
    for k, v in tx.LIGATURES.items():
        x = f"replace({x}, {_sql_lit(k)}, {_sql_lit(v)})"
    return sql_collapse(f"lower({x})")


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), {_sql_lit(tx.SPACE)}), lambda w: length(w) > 0)"


@query("strip_html", f"select review_id, {sql_collapse(sql_strip_html('text'))} as plain from reviews")
def _(t):
    return spread(t("reviews").select("review_id", "text")).select("review_id", tx.collapse_spaces(tx.strip_html(F.col("text"))).alias("plain"))


@query("clean_text", f"select review_id, {sql_clean('text')} as clean from reviews")
def _(t):
    return spread(t("reviews").select("review_id", "text")).select("review_id", tx.clean_text(F.col("text")).alias("clean"))


@query("min_words_filter", f"select review_id, clean from (select review_id, {sql_clean('text')} as clean from reviews) where len({sql_words('clean')}) >= 3")
def _(t):
    c = spread(t("reviews").select("review_id", "text")).select("review_id", tx.clean_text(F.col("text")).alias("clean"))
    return c.filter(tx.word_count(F.col("clean")) >= 3)


@query("text_stats", f"select review_id, cast(len({sql_words('text_cleaned')}) as int) as words, cast(length(text_cleaned) as int) as chars, round(coalesce(list_avg(list_transform({sql_words('text_cleaned')}, lambda w: length(w))), 0), 6) as avg_word, cast(greatest(1, length(coalesce(text_cleaned, '')) - length(regexp_replace(coalesce(text_cleaned, ''), '[.!?]', '', 'g'))) as int) as sentences from reviews")
def _(t):
    x = F.col("text_cleaned")
    return spread(t("reviews").select("review_id", "text_cleaned")).select("review_id", tx.word_count(x).alias("words"), F.length(x).alias("chars"), _r(tx.average_word_length(x)).alias("avg_word"), tx.sentence_count(x).alias("sentences"))


def sql_sentences(x: str) -> str:
    t = sql_collapse(f"coalesce({x}, '')")
    for a in tx.ABBREVIATIONS:
        t = f"replace({t}, {_sql_lit(a)}, replace({_sql_lit(a)}, '.', chr(1)))"
    t = f"regexp_replace({t}, '([.!?])\\s+([A-Z0-9\"''])', '\\1' || chr(2) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: length(s) >= 10)"


@query("sentence_units", f"select review_id, cast(i - 1 as int) as sentence_idx, review_id || '_s' || (i - 1) as sentence_id, s[i] as sentence from (select review_id, s, unnest(range(1, len(s) + 1)) as i from (select review_id, {sql_sentences('text')} as s from {REVIEWS}))")
def _(t):
    r = distinct_reviews(t("reviews"), "text")
    s = r.select("review_id", F.posexplode(tx.sentence_units(F.col("text"))).alias("sentence_idx", "sentence"))
    return s.select("review_id", "sentence_idx", F.concat("review_id", F.lit("_s"), F.col("sentence_idx").cast("string")).alias("sentence_id"), "sentence")


@query("sentence_month_counts", f"select coalesce(strftime(date, '%Y-%m'), 'NaT') as month, cast(sum(len(s)) as bigint) as sentences from (select date, {sql_sentences('text')} as s from {REVIEWS}) group by 1")
def _(t):
    r = distinct_reviews(t("reviews"), "text", "date")
    return r.groupBy(tx.month_label(F.col("date")).alias("month")).agg(F.sum(F.size(tx.sentence_units(F.col("text"))).cast("long")).alias("sentences"))


TOKENS = r"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: regexp_full_match(w, '{p}'))"


def sql_tokens(x: str, p: str = "[a-z_]{2,}") -> str:
    return TOKENS.format(x=x, p=p)


@query("negation_marks", "with t as (select review_id, " + sql_tokens("text_cleaned", "[a-z]+") + " as w from " + REVIEWS + "), n as (select review_id, w, unnest(range(1, len(w) + 1)) as i from t) select review_id, 'NOT_' || w[j] as mark, count(*) as n from (select review_id, w, unnest(range(i + 1, least(i + 2, len(w)) + 1)) as j from n where w[i] in ('not', 'no', 'nor', 'never')) where w[j] not in ('not', 'no', 'nor', 'never') group by all")
def _(t):
    w = tx.term_tokens(F.col("text_cleaned"), "[a-z]+")
    m = distinct_reviews(t("reviews"), "text_cleaned").select("review_id", F.explode(F.filter(tx.mark_negation(w, 2), lambda x: F.startswith(x, F.lit("NOT_")))).alias("mark"))
    return m.groupBy("review_id", "mark").agg(F.count(F.lit(1)).alias("n"))


_STOP = ", ".join(_sql_lit(w) for w in tx.STOP_WORDS if w not in tx.NEGATORS)


@query("stopword_filter", f"select review_id, array_to_string(list_filter({sql_tokens('text_cleaned')}, lambda w: w not in ({_STOP})), ' ') as kept from {REVIEWS}")
def _(t):
    return distinct_reviews(t("reviews"), "text_cleaned").select("review_id", F.array_join(tx.remove_stop_words(tx.term_tokens(F.col("text_cleaned"))), " ").alias("kept"))


@query("shortened_names", "select business_id, case when length(name) > 15 then substr(name, 1, 15) || '...' else name end as short from businesses")
def _(t):
    return t("businesses").select("business_id", tx.shorten(F.col("name"), 15).alias("short"))


# --- vectors: 64 dimensions, label as a given clustering ---

U = "(select vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from (select vec_id, label, cast(embedding as double[]) as v from embeddings))"
SUMS = "(select label, list(s order by i) as s, max(n) as n from (select label, i, sum(x) as s, count(*) as n from (select label, unnest(u) as x, unnest(range(1, len(u) + 1)) as i from " + U + ") group by label, i) group by label)"
CENTROIDS = "(select label, list(s order by i) as c, max(n) as n from (select label, i, avg(x) as s, count(*) as n from (select label, unnest(v) as x, unnest(range(1, len(v) + 1)) as i from (select label, cast(embedding as double[]) as v from embeddings)) group by label, i) group by label)"


@query("cluster_centroids", f"select label, n, round(c[1], 6) as first_value, round(list_sum(list_transform(c, lambda x: x * x)), 6) as square from {CENTROIDS}")
def _(t):
    c = ve.centroids(t("embeddings"), "label")
    return c.select("label", "n", _r(F.col("centroid")[0]).alias("first_value"), _r(ve.dot(F.col("centroid"), F.col("centroid"))).alias("square"))


@query("intra_cosine", f"select label, n, round((list_dot_product(s, s) - n) / (n * (n - 1)), 6) as intra from {SUMS} where n > 1")
def _(t):
    return ve.intra_cosine(t("embeddings"), "label").withColumn("intra", _r("intra"))


PAIRS = f"(select a.label as i, b.label as j, list_cosine_similarity(a.c, b.c) as similarity from {CENTROIDS} a join {CENTROIDS} b on a.label < b.label)"


@query("inter_centroid_cosine", f"select i, j, round(similarity, 6) as similarity from {PAIRS}")
def _(t):
    return ve.centroid_pairs(t("embeddings"), "label").withColumn("similarity", _r("similarity"))


@query("theme_separation", f"select i, round(1 - avg(similarity), 6) as separation from (select i, similarity from {PAIRS} union all select j, similarity from {PAIRS}) group by i")
def _(t):
    return ve.separation(ve.centroid_pairs(t("embeddings"), "label")).withColumn("separation", _r("separation"))


@query("theme_similarity_matrix", f"select i, array_to_string(list_transform(list(round(s, 4) order by j), lambda x: cast(cast(round(x * 10000) as bigint) as varchar)), ' ') as row from (select i, j, similarity as s from {PAIRS} union all select j, i, similarity from {PAIRS} union all select label, label, 1.0 from {CENTROIDS}) group by i")
def _(t):
    m = ve.similarity_matrix(ve.centroid_pairs(t("embeddings"), "label"))
    rows = m.select(F.explode(F.arrays_zip("groups", "matrix")).alias("z")).select(F.col("z.groups").alias("i"), F.col("z.matrix").alias("m"))
    return rows.select("i", F.array_join(F.transform("m", lambda x: F.round(F.round(x, 4) * 10000).cast("long").cast("string")), " ").alias("row"))


@query("cluster_size_std", "select round(stddev_pop(coalesce(n, 0)), 6) as size_std from range(12) k left join (select label, count(*) as n from embeddings group by label) l on l.label = k.range")
def _(t):
    return ve.size_spread(t("embeddings"), "label", 12).withColumn("size_std", _r("size_std"))


@query("cluster_entropy", "select round(-sum(n / t * ln(n / t)), 6) as entropy, min(n) as smallest, max(n) as largest from (select count(*) as n, sum(count(*)) over () as t from embeddings group by label)")
def _(t):
    return ve.size_entropy(t("embeddings"), "label").withColumn("entropy", _r("entropy"))


@query("cluster_consistency", f"select label, n, round(list_dot_product(s, s) / (n * n), 6) as consistency from {SUMS} where n > 5")
def _(t):
    return ve.consistency(t("embeddings"), "label").withColumn("consistency", _r("consistency"))


@query("contextual_variation", f"select label, n, round(1 - (list_dot_product(s, s) - n) / (n * (n - 1)), 6) as variation from {SUMS} where n > 1")
def _(t):
    return ve.contextual_variation(t("embeddings"), "label").withColumn("variation", _r("variation"))


@query("medoid_examples", f"select label, vec_id, cast(rank as int) as rank, round(d, 6) as distance from (select u.label, u.vec_id, 1 - list_dot_product(u.u, s.s) / s.n as d, row_number() over (partition by u.label order by round(1 - list_dot_product(u.u, s.s) / s.n, 9), u.vec_id) as rank from {U} u join {SUMS} s on u.label = s.label) where rank <= 10")
def _(t):
    return ve.medoids(t("embeddings"), "vec_id", "label").select("label", "vec_id", "rank", _r("distance").alias("distance"))


CLOSE = f"(select e.label, e.vec_id, c.n, row_number() over (partition by e.label order by round(list_cosine_similarity(cast(e.embedding as double[]), c.c), 9) desc, e.vec_id) as rank from embeddings e join {CENTROIDS} c on e.label = c.label)"


@query("closest_examples", f"select label, vec_id, cast(rank as int) as rank from {CLOSE} where rank <= 10")
def _(t):
    return lx.select_closest(ve.closest_to_centroid(t("embeddings"), "vec_id", "label"), 10).select("label", "vec_id", "rank")


@query("diverse_examples", f"select label, vec_id, cast(rank as int) as rank from (select *, cast(floor(n * 0.8) as bigint) as safe from {CLOSE}) where case when safe < 10 then rank <= 10 else rank <= safe and (rank <= 2 or ((rank - 3) % greatest(1, (safe - 2) // 8) = 0 and (rank - 3) // greatest(1, (safe - 2) // 8) < 8)) end")
def _(t):
    return lx.select_diverse_unfloored(ve.closest_to_centroid(t("embeddings"), "vec_id", "label"), 10).select("label", "vec_id", "rank")


@query("top_k_neighbors", f"select query, vec_id, cast(rank as int) as rank, round(s, 6) as similarity from (select q.vec_id as query, e.vec_id, list_dot_product(q.u, e.u) as s, row_number() over (partition by q.vec_id order by round(list_dot_product(q.u, e.u), 9) desc, e.vec_id) as rank from {U} q join {U} e on e.vec_id <> q.vec_id where q.vec_id % 100 = 0) where rank <= 5")
def _(t):
    e = t("embeddings")
    return ve.top_neighbours(e, e.filter("vec_id % 100 = 0"), "vec_id", k=5).select("query", "vec_id", "rank", _r("similarity").alias("similarity"))


@query("cosine_links", f"select a.vec_id, count(b.vec_id) as links from {U} a left join {U} b on a.vec_id <> b.vec_id and list_dot_product(a.u, b.u) > 0.4 group by a.vec_id")
def _(t):
    e = t("embeddings")
    return ve.link_counts(e, "vec_id", ve.similar_links(e, "vec_id", threshold=0.4))


@query("near_dup_drop_all", f"select vec_id from embeddings where vec_id not in (select a.vec_id from {U} a join {U} b on a.vec_id <> b.vec_id and list_dot_product(a.u, b.u) > 0.45)")
def _(t):
    e = t("embeddings")
    return ve.drop_near_duplicates(e, "vec_id", ve.similar_links(e, "vec_id", threshold=0.45)).select("vec_id")


@query("near_dup_keep_first")
def _(t):
    e = t("embeddings")
    return ve.keep_first_near_duplicates(e, "vec_id", ve.similar_links(e, "vec_id", threshold=0.4)).select("vec_id")


SIL = f"(select a.vec_id, a.label, b.label as other, sum(sqrt(list_sum(list_transform(list_zip(cast(a.embedding as double[]), cast(b.embedding as double[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) as s, count(*) as n from embeddings a, embeddings b group by all)"
SILS = f"(select vec_id, label, case when max(n) filter (other = label) <= 1 then 0 else (min(s / n) filter (other <> label) - max(s / greatest(n - 1, 1)) filter (other = label)) / greatest(min(s / n) filter (other <> label), max(s / greatest(n - 1, 1)) filter (other = label)) end as silhouette from {SIL} group by vec_id, label)"


@query("silhouette", f"select round(avg(silhouette), 5) as silhouette, count(*) as n from {SILS}")
def _(t):
    return ve.silhouette(t("embeddings"), "vec_id", "label").agg(F.round(F.avg("silhouette"), 5).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@query("silhouette_by_cluster", f"select label, round(avg(silhouette), 5) as silhouette from {SILS} group by label")
def _(t):
    return ve.silhouette(t("embeddings"), "vec_id", "label").groupBy("label").agg(F.round(F.avg("silhouette"), 5).alias("silhouette"))


@query("model_pair_cosine", "select m.model, round(list_cosine_similarity(list_slice(a.v, m.s, m.s + 15), list_slice(b.v, m.s, m.s + 15)), 6) as similarity from (values ('dims_a', 1), ('dims_b', 17), ('dims_c', 33), ('dims_d', 49)) m(model, s), (select cast(embedding as double[]) as v from embeddings where vec_id = 12) a, (select cast(embedding as double[]) as v from embeddings where vec_id = 13) b")
def _(t):
    e = t("embeddings").filter("vec_id in (12, 13)")
    models = F.array(*[F.struct(F.lit(f"dims_{c}").alias("model"), F.lit(s).alias("s")) for c, s in zip("abcd", (1, 17, 33, 49))])
    long = e.select("vec_id", F.explode(models).alias("m"), "embedding").select("vec_id", "m.model", F.slice("embedding", F.col("m.s"), 16).alias("v"))
    pair = long.groupBy("model").agg(F.max(F.when(F.col("vec_id") == 12, F.col("v"))).alias("a"), F.max(F.when(F.col("vec_id") == 13, F.col("v"))).alias("b"))
    return pair.filter("a is not null and b is not null").select("model", _r(ve.cosine(F.col("a"), F.col("b"))).alias("similarity"))


@query("elbow_k", "with c as (select * from (values (6, .42), (7, .48), (8, .53), (9, .57), (10, .61), (11, .63), (12, .65), (13, .66), (14, .67)) v(k, y)), s as (select k, cast(y as double) as y, (k - 6) / 8.0 as a, (y - .42) / .25 as b from c) select k, y, round(abs((a - 0) - (b - 0)) / sqrt(2), 6) as distance, row_number() over (order by round(abs(a - b), 9) desc, k) = 1 as selected from s")
def _(t):
    spark = t("region").sparkSession
    curve = spark.createDataFrame(list(zip(range(6, 15), (0.42, 0.48, 0.53, 0.57, 0.61, 0.63, 0.65, 0.66, 0.67))), "k int, y double")
    return cl.elbow(curve, "k", "y").withColumn("distance", _r("distance"))


@query("context_tree_cut")
def _(t):
    return cl.context_labels(t("embeddings").withColumn("part", F.pmod(F.col("label"), F.lit(2))), "part", "vec_id", k=5).groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


@query("kmeans_probe")
def _(t):
    return cl.probe_k(t("embeddings"), (4, 6, 8))


@query("whitened_moments")
def _(t):
    w = ve.whiten(t("embeddings"), k=16).select(F.posexplode("whitened").alias("i", "x"))
    return w.groupBy("i").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_samp("x"), 6).alias("variance"))


# --- lexical: distinct reviews, theme as cluster ---

DOCS = f"(select r.review_id, a.theme_id, r.lemmas from {REVIEWS} r join (select review_id, min(theme_id) as theme_id from review_assignments where theme_id >= 0 group by review_id) a on r.review_id = a.review_id)"


def _docs(t) -> DataFrame:
    themes = t("review_assignments").filter("theme_id >= 0 and review_id is not null").groupBy("review_id").agg(F.min("theme_id").alias("theme_id"))
    return distinct_reviews(t("reviews"), "lemmas").join(themes, "review_id")


P = lx.TfIdf(min_df=15, max_df=0.8, max_features=3000, sublinear=True, pattern="[a-z_]{2,}")
TF = f"(select review_id, theme_id, w as term, count(*) as tf from (select review_id, theme_id, unnest({sql_tokens('lemmas')}) as w from {DOCS}) group by all)"
VOCAB = f"(select term, df, ln((1 + n) / (1 + df)) + 1 as idf from (select term, count(*) as df, sum(tf) as total, (select cast(count(*) as double) from {DOCS}) as n from {TF} group by term) where df >= 15 and df <= 0.8 * n order by total desc, term limit 3000)"
WEIGHTS = f"(select review_id, theme_id, term, tf, x / sqrt(sum(x * x) over (partition by review_id)) as w from (select t.review_id, t.theme_id, t.term, t.tf, (1 + ln(t.tf)) * v.idf as x from {TF} t join {VOCAB} v on t.term = v.term))"


def _weights(t) -> tuple[DataFrame, DataFrame]:
    docs = _docs(t)
    return docs, lx.weigh(docs, "review_id", "lemmas", P, "theme_id")


@query("tfidf_global", f"select review_id, term, tf, round(w, 6) as w from {WEIGHTS}")
def _(t):
    return _weights(t)[1].select("review_id", "term", "tf", _r("w").alias("w"))


@query("auto_stopwords", f"select term, df, round(df / n, 6) as share from (select term, df, n from (select term, count(*) as df, sum(tf) as total, (select cast(count(*) as double) from {DOCS}) as n from {TF} group by term order by total desc, term limit 3000) where df / n >= 0.05 and length(term) >= 3 and term not in ('not', 'no', 'nor', 'never')) order by df / n desc, term limit 60")
def _(t):
    return lx.auto_stop_words(_docs(t), "review_id", "lemmas", share=0.05).withColumn("share", _r("share"))


MEANS = f"(select w.theme_id, w.term, sum(w.w) / max(s.n) as mean, count(*) as df, max(s.n) as n from {WEIGHTS} w join (select theme_id, count(*) as n from {DOCS} group by theme_id) s on w.theme_id = s.theme_id group by w.theme_id, w.term)"


@query("cluster_terms", f"select theme_id, term, cast(rank as int) as rank, round(mean, 6) as mean from (select *, row_number() over (partition by theme_id order by round(mean, 9) desc, term) as rank from {MEANS}) where rank <= 10")
def _(t):
    docs, w = _weights(t)
    return lx.top_terms(lx.group_means(w, docs, "theme_id"), "theme_id", "mean").select("theme_id", "term", "rank", _r("mean").alias("mean"))


@query("cluster_terms_contrastive", f"with g as (select term, sum(w) / (select count(*) from {DOCS}) as a from {WEIGHTS} group by term) select theme_id, term, cast(rank as int) as rank, round(score, 6) as score from (select theme_id, m.term, mean - 0.6 * a as score, row_number() over (partition by theme_id order by round(mean - 0.6 * a, 9) desc, m.term) as rank from {MEANS} m join g on g.term = m.term where df >= 0.02 * n) where rank <= 10")
def _(t):
    docs, w = _weights(t)
    return lx.contrastive_terms(w, docs, "theme_id").select("theme_id", "term", "rank", _r("score").alias("score"))


@query("cluster_terms_local", f"with s as (select theme_id, count(*) as n from {DOCS} group by theme_id), v as (select t.theme_id, t.term, max(s.n) as n, ln((1.0 + max(s.n)) / (1.0 + count(*))) + 1 as idf from {TF} t join s on s.theme_id = t.theme_id group by t.theme_id, t.term having count(*) >= greatest(2, floor(0.02 * max(s.n))) and count(*) <= 0.75 * max(s.n)), x as (select t.review_id, t.theme_id, t.term, v.n, t.tf * v.idf as x from {TF} t join v on v.theme_id = t.theme_id and v.term = t.term), w as (select *, x / sqrt(sum(x * x) over (partition by review_id)) as w from x) select theme_id, term, cast(rank as int) as rank, round(score, 6) as score from (select theme_id, term, sum(w) / max(n) as score, row_number() over (partition by theme_id order by round(sum(w) / max(n), 9) desc, term) as rank from w group by theme_id, term) where rank <= 10")
def _(t):
    p = lx.TfIdf(max_df=0.75, pattern="[a-z_]{2,}")
    return lx.local_terms(_docs(t), "review_id", "lemmas", "theme_id", p).select("theme_id", "term", "rank", _r("score").alias("score"))


COSINE = f"(select d.theme_id, d.review_id, coalesce(c.s, 0) as s, count(*) over (partition by d.theme_id) as n from {DOCS} d left join (select w.review_id, sum(w.w * m.mean) / max(l.l) as s from {WEIGHTS} w join {MEANS} m on m.theme_id = w.theme_id and m.term = w.term join (select theme_id, sqrt(sum(mean * mean)) as l from {MEANS} group by theme_id) l on l.theme_id = w.theme_id group by w.review_id) c on c.review_id = d.review_id)"
RANKED = f"(select *, row_number() over (partition by theme_id order by round(s, 9) desc, review_id) as rank from {COSINE})"


@query("centroid_closest_reviews", f"select theme_id, review_id, cast(rank as int) as rank, round(s, 6) as similarity from {RANKED} where rank <= 15")
def _(t):
    docs, w = _weights(t)
    return lx.select_closest(lx.centroid_similarity(w, docs, "review_id", "theme_id")).select("theme_id", "review_id", "rank", _r("similarity").alias("similarity"))


@query("centroid_diverse_reviews", f"select theme_id, review_id, cast(rank as int) as rank from (select *, least(n, greatest(cast(floor(n * 0.8) as bigint), 15)) as safe from {RANKED}) where rank <= safe and (safe <= 15 or rank <= 2 or ((rank - 3) % greatest(1, (safe - 2) // 13) = 0 and (rank - 3) // greatest(1, (safe - 2) // 13) < 13))")
def _(t):
    docs, w = _weights(t)
    return lx.select_diverse(lx.centroid_similarity(w, docs, "review_id", "theme_id")).select("theme_id", "review_id", "rank")


@query("heaviest_reviews", f"select theme_id, review_id, cast(rank as int) as rank, round(total, 6) as total from (select theme_id, review_id, sum(w) as total, row_number() over (partition by theme_id order by round(sum(w), 9) desc, review_id) as rank from {WEIGHTS} group by theme_id, review_id) where rank <= 15")
def _(t):
    _, w = _weights(t)
    return lx.row_sums(w, "review_id", "theme_id").filter("rank <= 15").select("theme_id", "review_id", "rank", _r("total").alias("total"))


@query("phrase_rank", f"with p as (select review_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as phrase from (select review_id, {sql_tokens('lemmas')} as w from {DOCS})), c as (select phrase, count(*) as count, count(distinct review_id) as df from p group by phrase order by count desc, phrase limit 10) select * from c where df <= 0.8 * (select count(*) from {DOCS})")
def _(t):
    docs = _docs(t)
    tokens = tx.term_tokens(F.col("lemmas"))
    pairs = docs.select("review_id", F.explode(F.filter(tx.with_bigrams(tokens), lambda w: F.contains(w, F.lit(" ")))).alias("phrase"))
    return lx.rank_phrases(pairs, "review_id", "phrase", docs.count())


@query("word_vector_mean", f"with v as (select w, row_number() over (order by n desc, w) as i from (select term as w, sum(tf) as n from {TF} group by term order by n desc, w limit 200)), e as (select v.w, cast(e.embedding as double[]) as v from v join embeddings e on e.vec_id = v.i), d as (select review_id, unnest({sql_tokens('lemmas')}) as w from {DOCS}), s as (select d.review_id, count(*) as n, sum(e.v[1]) / count(*) as x from d join e on e.w = d.w group by d.review_id) select o.review_id, coalesce(s.n, 0) as n, round(coalesce(s.x, 0), 6) as first_value from {DOCS} o left join s on s.review_id = o.review_id")
def _(t):
    docs = _docs(t)
    tokens = docs.select("review_id", tx.term_tokens(F.col("lemmas")).alias("w"))
    top = tokens.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(200).collect()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["word"], i) for i, r in enumerate(top, 1)], "word string, i long")
    vectors = F.broadcast(ids.join(t("embeddings").select("vec_id", "embedding"), F.col("i") == F.col("vec_id")).select("word", "embedding"))
    return ve.mean_of_words(tokens, "review_id", "w", vectors).select("review_id", "n", _r(F.col("embedding")[0]).alias("first_value"))
