import unicodedata
from array import array
from collections import Counter

import numpy as np
import pytest

from lodestone.llm.terms import ARRAY_MAX, BLOCK, bitmap_statistics, container, container_ids, distinctive_terms, mark_terms, normalise_term, term_bitmaps, term_statistics

TEXTS = ["Soup soup! SOUP; great", "soup great great​ (great)", "NOT_good good  café café", "", None, "!!! --", "zzz­z zzzz ZZZZ"]


def _frame(spark, rows=None):
    rows = rows if rows is not None else [(f"r{i}", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([(*r, "x") for r in rows], "review_id string, lemmas string, term string")


def _brute(texts):
    occ, df = Counter(), Counter()
    for t in texts:
        c = Counter(x for p in (t or "").split() if (x := normalise_term(p)))
        occ.update(c)
        df.update(c.keys())
    return occ, df


def test_terms():
    assert normalise_term('"Café,') == "café" == normalise_term(unicodedata.normalize("NFD", "CAFÉ!"))
    assert normalise_term("NOT_go.") == "not_go"
    assert normalise_term("…") == ""
    assert normalise_term("a-b'c)") == "a-b'c"


@pytest.mark.parametrize("ids", [[0], list(range(0, 9000, 2)), list(range(ARRAY_MAX)), list(range(100, 100 + ARRAY_MAX)), list(range(BLOCK)), [5, 65535]])
def test_containers_round_trip(ids):
    data = container(array("H", ids))
    assert container_ids(data).tolist() == ids and len(data) <= BLOCK // 8


def test_statistics_equal_brute_force(spark):
    occ, df = _brute(TEXTS)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_statistics(_frame(spark).repartition(3), "lemmas").collect()}
    assert got.pop(None) == (sum(occ.values()), 4)
    assert got == {t: (occ[t], df[t]) for t in occ}


def test_bitmap_cardinality(spark):
    b = term_bitmaps(_frame(spark), "lemmas").filter("term = 'great'").collect()
    assert sum(len(container_ids(r["ids"])) for r in b) == 2 == sum(r["records"] for r in b)


def test_records_are_read_from_the_bitmaps(spark):
    sizes = [1, 255, ARRAY_MAX - 1, ARRAY_MAX, ARRAY_MAX + 1, BLOCK]
    rows = [(t, block, -1, n + block, bytes(container(array("H", range(BLOCK - n, BLOCK))))) for t in ("a", "b", None) for block, n in enumerate(sizes) if t != "b" or n != BLOCK]
    made = spark.createDataFrame(rows, "term string, block long, records int, occurrences long, ids binary").repartition(3)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in bitmap_statistics(made).collect()}
    assert got == {"a": (sum(sizes) + 15, sum(sizes)), "b": (sum(sizes[:-1]) + 10, sum(sizes[:-1])), None: (sum(sizes) + 15, sum(sizes))}
    stats = term_statistics(_frame(spark), "lemmas")
    assert "length(ids" in stats._jdf.queryExecution().optimizedPlan().toString()  # it asks the containers
    assert term_bitmaps(_frame(spark), "lemmas").filter("ids is null").count() == 0


def test_a_term_of_more_than_a_block(spark):
    n = BLOCK + 5000
    df = spark.range(n, numPartitions=1).selectExpr("cast(id as string) as review_id", "if(id % 2 = 0, 'all all even', 'all') as lemmas")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_statistics(df, "lemmas").collect()}
    assert got == {"all": (n + n // 2, n), "even": (n // 2, n // 2), None: (n + n // 2 * 2, n)}


def test_marks(spark):
    rows = [(f"r{i}", "all " + ("half " if i % 2 else "") + f"own{i} own{i // 3 * 3}") for i in range(40)]
    got = {(r["term"], r["mark"]) for r in mark_terms(term_statistics(_frame(spark, rows), "lemmas")).collect() if r["mark"]}
    assert ("all", "common") in got and ("half", "common") in got and ("own1", "rare") in got and not any(t == "own0" for t, _ in got)


def test_distinctive(spark):
    rows = [(f"r{i}", "food good place " + ("quince quince quince" if i in (3, 7) else "")) for i in range(30)] + [("n", None), ("e", "")]
    for hot in (1e-9, 0.9):  # everything is joined by shuffle, or everything by broadcast
        got = distinctive_terms(_frame(spark, rows), "review_id", "lemmas", hot_share=hot).collect()
        z = {(r["review_id"], r["term"]): r["z"] for r in got}
        assert len(z) == 92 and z["r3", "quince"] > 3 * abs(z["r3", "food"])
    y, n, Y, N, a0 = 3.0, 6.0, 6.0, 96.0, 1000.0
    a = a0 * Y / N
    want = np.log((y + a) / (n + a0 - y - a)) - np.log((Y - y + a) / (N - n + a0 - Y + y - a))
    assert z["r3", "quince"] == pytest.approx(want / np.sqrt(1 / (y + a) + 1 / (Y - y + a)))
    only = distinctive_terms(_frame(spark, rows), "review_id", "lemmas", min_tf=3).collect()
    assert {(r["review_id"], r["term"]) for r in only} == {("r3", "quince"), ("r7", "quince")}


def test_empty_and_single_term(spark):
    e = _frame(spark, [])
    assert mark_terms(term_statistics(e, "lemmas")).count() == 0
    assert distinctive_terms(e, "review_id", "lemmas").count() == 0
    assert distinctive_terms(_frame(spark, [("a", "x x")]), "review_id", "lemmas").first()["z"] == 0.0
