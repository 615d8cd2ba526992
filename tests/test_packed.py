import pytest

from lodestone.operators.packed import delimiter_scores, explode_packed, infer_delimiters, split_packed

IDS = ["aB3_dEfGhIjKlMnOpQrS-1", "zY9xWvUtSrQpOnMlKjIh_2", "0123456789abcdefABCDEF"]


@pytest.mark.parametrize("d", [",", ", ", ";", "|", " | ", "\n", "\t", "、", "，", " ,  "])
def test_every_delimiter(d):
    assert split_packed(d.join(IDS), d.strip(" ")) == IDS


def test_quotes_brackets_and_empty_items():
    assert split_packed('["Ann ""Ace"" Lee", "B, C"]', ",") == ['Ann "Ace" Lee', "B, C"]
    assert split_packed("['2016', '2017']", ",") == ["2016", "2017"]
    assert split_packed(" a, , b,", ",") == ["a", "b"]
    assert split_packed('" x ", y', ",") == [" x ", "y"]
    assert split_packed("a, a", ",") == ["a", "a"]
    assert split_packed("it's, O'Brien", ",") == ["it's", "O'Brien"]


@pytest.mark.parametrize("v", [None, "", "  ", "None", "n/a", "[]", "-", "null"])
def test_nothing(v):
    assert split_packed(v, ",") == []


def _users(spark, rows):
    return spark.createDataFrame(rows, "user_id string, friends string, elite string, item string")


def test_explode(spark):
    rows = [
        ("u1", ", ".join(IDS), "2010|2011", "x"),
        ("u1", ", ".join(IDS), "2010|2011", "x"),
        ("u2", f'"{IDS[0]}"; {IDS[1]} | "Lee, Ann"', "2010", None),
        ("u3", None, "None", ""),
        (None, IDS[0], "2011", "x"),
        ("u4", IDS[0], "2009 2010", "x"),
    ]
    got = sorted(map(tuple, explode_packed(_users(spark, rows), "user_id", ["friends", "elite"]).collect()))
    assert got == sorted(
        [("u1", "friends", i, x) for i, x in enumerate(IDS)]
        + [("u1", "elite", 0, "2010"), ("u1", "elite", 1, "2011")]
        + [("u2", "friends", 0, IDS[0]), ("u2", "friends", 1, IDS[1]), ("u2", "friends", 2, "Lee, Ann"), ("u2", "elite", 0, "2010")]
        + [("u4", "friends", 0, IDS[0]), ("u4", "elite", 0, "2009"), ("u4", "elite", 1, "2010")]
    )


def test_named_sources_and_large_source_tables(spark):
    df = spark.createDataFrame([("a", "1999;2000", "s1"), ("b", "2001;2002", "s1"), ("c", "2003/2004", "s2"), ("d", None, None)], "id string, years string, src string")
    want = [("a", 0, "1999"), ("a", 1, "2000"), ("b", 0, "2001"), ("b", 1, "2002"), ("c", 0, "2003"), ("c", 1, "2004")]
    for most in (20000, 0):  # 0: the table of sources is joined, not sent out
        got = explode_packed(df, "id", ["years"], "src", most).select("id", "pos", "item").collect()
        assert sorted(map(tuple, got)) == want


def test_scores_and_empty_table(spark):
    f = spark.createDataFrame([("f", "2001,2002,2003"), ("f", "2004,2005"), ("f", None)], "field_name string, value string")
    best = infer_delimiters(f).collect()
    assert [(r.delimiter, r.score > 0.9) for r in best] == [(",", True)]
    assert delimiter_scores(f.limit(0)).count() == 0
    assert explode_packed(_users(spark, []), "user_id", ["friends", "elite"]).count() == 0


def test_missing_column(spark):
    with pytest.raises(ValueError, match="friends"):
        explode_packed(spark.range(1), "id", ["friends"])


@pytest.mark.parametrize("source", [None, "src"])
def test_more_sources_than_are_broadcast(spark, source):
    rows = [("u1", "a_long_user_name_01; Ann", "2010|2011", "x", "e1"), ("u2", '"B, C", D', "[2012]", None, "e2"), ("u3", None, "none", None, None)]
    df = spark.createDataFrame(rows, "user_id string, friends string, elite string, item string, src string")
    few = sorted(map(tuple, explode_packed(df, "user_id", ["friends", "elite"], source, max_sources=1).collect()))
    assert few == sorted(map(tuple, explode_packed(df, "user_id", ["friends", "elite"], source).collect())) and few
