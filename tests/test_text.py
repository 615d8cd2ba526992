import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.rows import distinct_reviews
from lodestone.operators.providers import lemma_string


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "raw, clean",
    [
        (" jjj n   kl lo ", "jjj n kl lo"),
        (None, "none"),
        ("<p>Don't <a href='x'>click</a> it&#39;s Café\r\nhttps://a.b/c ok</p><script>var a=1;</script>", "do not it is cafe ok"),
        ("We won't; I'm here now", "we will not; i am here now"),
        ("", ""),
    ],
)
def test_clean(spark, raw, clean):
    assert one(spark, raw, tx.clean_text) == clean


def test_clean_keeps_null_when_told(spark):
    assert one(spark, None, lambda x: tx.clean_text(x, null_as=None)) is None


@pytest.mark.parametrize("x, n", [("ok", 1), ("a. b! c?", 3), (None, 1), ("", 1)])
def test_sentence_count(spark, x, n):
    assert one(spark, x, tx.sentence_count) == n


@pytest.mark.parametrize(
    "x, units",
    [
        ("Dr. Smith was very kind. He fixed my tooth.", ["Dr. Smith was very kind.", "He fixed my tooth."]),
        ("We drove up Mt. Hood today. It was cold.", ["We drove up Mt. Hood today.", "It was cold."]),
        ("Made in the U.S. Great product here.", ["Made in the U.S.", "Great product here."]),
        ("Yes! No! This place is great.", ["This place is great."]),
        ("good food. bad service here.", ["good food. bad service here."]),
        (None, []),
        ("   ", []),
    ],
)
def test_sentence_units(spark, x, units):
    assert one(spark, x, tx.sentence_units) == units


def test_negation(spark):
    split = lambda s: lambda x: tx.mark_negation(F.split(x, " "), s)
    assert one(spark, "wait was not too long", split(2)) == "wait was not NOT_too NOT_long too long".split()
    assert one(spark, "wait was not too long", split(0)) == "wait was not too long".split()
    assert one(spark, "not never go", split(2)) == "not NOT_go never NOT_go go".split()
    # negators in between do not use up the scope
    assert one(spark, "not never too long", split(2)) == "not NOT_too NOT_long never NOT_too NOT_long too long".split()
    assert one(spark, "no", split(3)) == ["no"]
    assert one(spark, None, split(2)) is None


def test_words_and_lengths(spark):
    assert one(spark, " a  bb ", tx.word_count) == 2
    assert one(spark, "", tx.word_count) == 0
    assert one(spark, None, tx.average_word_length) == 0.0
    assert one(spark, "aa bbbb", tx.average_word_length) == 3.0


def test_lemmas(spark):
    assert one(spark, "The cherries were not dishes", lambda x: lemma_string(x, 2)) == "cherry not dish NOT_dishes"


def test_year_and_month(spark):
    assert [one(spark, v, tx.year_of) for v in ("2018-07-01", "1. Mai 2019", "7/8/2020", None, "?")] == [2018, 2019, 2020, None, None]
    assert one(spark, None, lambda x: tx.month_label(F.try_to_timestamp(x))) == "NaT"


def test_distinct_reviews_take_the_first_loaded(spark):
    df = spark.createDataFrame([("a", "late", 2), ("a", "early", 1), ("a", "null", None), (None, "x", 1), ("b", None, 1)], "review_id string, text string, loaded_at int")
    assert sorted(map(tuple, distinct_reviews(df, "text").collect())) == [("a", "early"), ("b", None)]
    assert distinct_reviews(df.limit(0), "text").count() == 0
