import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical as lx
from lodestone.operators import relational as rel
from lodestone.operators.providers import TermsLabeler, embed, hashed_embedding, label_theme, vocabulary_coverage
from lodestone.plans.pipeline import Settings, run_themes
from lodestone.sources import readers, sinks
from lodestone.streaming.prevalence import stream_parquet, windowed_counts

THEMES = ("espresso foam bean cup roast latte barista mocha crema filter grinder aroma".split(), "bed pillow view garden balcony quiet shower towel lamp carpet window sheet".split(), "garage car ticket barrier ramp level space meter lane exit queue driver".split())


@pytest.fixture(scope="module")
def reviews(spark):
    r = np.random.default_rng(3)
    rows = [(f"r{i:03d}", "b1", " ".join(r.choice(THEMES[i % 3], 6, False))) for i in range(90)]
    return spark.createDataFrame([*rows, ("x1", "b2", "alone"), ("x2", None, None)], "review_id string, business_id string, text string")


def test_themes_end_to_end(spark, reviews, tmp_path):
    s = Settings(k_range=(2, 3), stop_share=0.9, weights=lx.TfIdf(min_df=2, max_df=1.0, max_features=500, sublinear=True, pattern="[a-zA-Z_]{2,}"))
    result = run_themes(reviews, "b1", "Bistro One", s=s)
    assert result["metadata"]["total_reviews"] == 90
    assert result["metadata"]["k"] in (2, 3)
    assert result["themes"] and len(result["review_assignments"]) == result["metadata"]["main_context_reviews"]
    path = sinks.write_result(result, str(tmp_path), "b1")
    doc = json.load(open(path))
    assert list(doc["themes"]) == [str(t) for t in result["metadata"]["theme_ids"]]
    back = readers.read_result(spark, path)
    assert readers.result_assignments(back).count() == len(result["review_assignments"])
    assert readers.result_themes(back).count() == len(result["themes"])
    assert run_themes(reviews, "b2", s=s) == {} and run_themes(reviews, "none", s=s) == {}


def test_old_result_shape(spark, tmp_path):
    p = tmp_path / "themes.json"
    p.write_text(json.dumps({"3": {"theme_name": "a", "keywords": ["k"], "review_count": 2}}))
    assert [tuple(r) for r in readers.result_themes(readers.read_result(spark, str(p))).select("theme_id", "theme_name").collect()] == [(3, "a")]


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([("b1", 2), ("b2", None)], "business_id string, n int")
    for fmt in ("parquet", "csv", "json"):
        p = str(tmp_path / f"t.{fmt}")
        getattr(df.write, fmt)(p, **({"header": True} if fmt == "csv" else {}))
        assert readers.read_table(spark, p).count() == 2
    with pytest.raises(ValueError, match="no reader"):
        readers.read_table(spark, "x.xml")
    assert readers.resolve_path("a/b", "/r") == "/r/a/b" and readers.resolve_path("/a", "/r") == "/a"
    scan = readers.reviews_of(readers.read_table(spark, str(tmp_path / "t.parquet")), "b1")
    assert "EqualTo(business_id,b1)" in scan._jdf.queryExecution().toString()


def test_vectors_by_model(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.eye(3))
    v = readers.read_numpy_vectors(spark, {"m": str(tmp_path / "m.npy")})
    sinks.write_vectors(v, str(tmp_path / "out"))
    assert sorted(r["vec_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
    assert sinks.seeded_sample(v, "vec_id", 2).collect() == sinks.seeded_sample(v.repartition(3), "vec_id", 2).collect()


def test_providers(spark):
    class Lengths:
        def embed(self, texts):
            return [[len(t), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "id int, t string")
    assert {r["id"]: r["embedding"] for r in embed(df, "t", Lengths).collect()} == {1: [3.0, 1.0], 2: None}
    h = [r["e"] for r in hashed_embedding(df, "t", "e", 16).orderBy("id").collect()]
    assert np.linalg.norm(h[0]) == pytest.approx(1, abs=1e-6) and np.linalg.norm(h[1]) == 0
    assert label_theme(TermsLabeler(), ["soup", "hot"], [], [])["theme_name"] == "Soup Hot"

    class Bad:
        def complete(self, prompt):
            return "no json"

    with pytest.raises(ValueError, match="no JSON"):
        label_theme(Bad(), ["a"], [], [])
    words = spark.createDataFrame([(["a", "b"],), (["b"],)], "w array<string>")
    vec = spark.createDataFrame([("b", [1.0])], "word string, embedding array<float>")
    assert tuple(vocabulary_coverage(words, "w", vec).first()) == (2, 1)


def test_selection_shapes(spark):
    def ranks(n):
        return spark.range(1, n + 1).select(F.lit("g").alias("g"), F.col("id").cast("int").alias("rank"), F.lit(n).cast("long").alias("n"))

    pick = lambda df: [r["rank"] - 1 for r in df.orderBy("rank").collect()]
    assert pick(lx.select_diverse(ranks(100))) == [0, 1, *range(2, 80, 6)]
    assert pick(lx.select_diverse(ranks(18))) == list(range(15))
    assert pick(lx.select_diverse_unfloored(ranks(100))) == [0, 1, *range(2, 72, 9)]
    assert pick(lx.select_diverse_unfloored(ranks(12))) == list(range(10))


def test_phrase_rank_filters_after_the_cut(spark):
    rows = [(d, "all over") for d in range(12)] + [(d % 5, f"p {i}") for i in range(10) for d in range(2 + i % 2)]
    df = spark.createDataFrame(rows, "id long, phrase string")
    assert lx.rank_phrases(df, "id", "phrase", 12).count() == 9


def test_business_lookup(spark):
    b = spark.createDataFrame([("1", " The (Inn) ", 5, 1), ("2", "the (inn)", 9, 1), ("3", "The (Inn)", 99, 0), ("4", None, 1, 1)], "business_id string, name string, review_count int, is_open int")
    assert [r["business_id"] for r in rel.find_businesses(b, "THE (INN)").collect()] == ["2", "1"]
    assert [r["business_id"] for r in rel.find_businesses(b, "(", contains=True, open_only=False).collect()] == ["3", "2", "1"]
    assert rel.find_businesses(b, "none").count() == 0


def test_duplicates_with_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", "x", 3)], "name string, address string, _n int")
    got = rel.flag_duplicates(df.withColumnRenamed("_n", "id"), ["name", "address"]).collect()
    assert {r["id"]: r["is_duplicate"] for r in got} == {1: True, 2: True, 3: False}
    j = rel.join_suffixed(df.select("name", "address"), df.select("name", F.col("address")), "name", ("_l", "_r"))
    assert set(j.columns) == {"name", "address_l", "address_r"}


def test_tfidf_against_the_formula(spark):
    docs = spark.createDataFrame([(1, "a1 bb bb"), (2, "bb cc"), (3, ""), (4, None)], "id int, t string")
    got = {(r["id"], r["term"]): r["w"] for r in lx.weigh(docs, "id", "t", lx.TfIdf()).collect()}
    idf = lambda df: np.log((1 + 4) / (1 + df)) + 1
    row = np.array([idf(1), 2 * idf(2)])
    row /= np.linalg.norm(row)
    assert got[1, "a1"] == pytest.approx(row[0]) and got[1, "bb"] == pytest.approx(row[1])
    assert set(got) == {(1, "a1"), (1, "bb"), (2, "bb"), (2, "cc")}


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = windowed_counts(stream_parquet(spark, str(tmp_path / "in"), str(tmp_path / "in")), "ts", "event_type")
    run = q.writeStream.format("memory").queryName("prevalence").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(spark.table("prevalence").collect()) == sorted(windowed_counts(events, "ts", "event_type").collect())
