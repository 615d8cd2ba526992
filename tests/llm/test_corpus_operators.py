from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import clusters
from lodestone.llm.clusters import alike_groups, communities, components, modularity, prefix_links, shingle_words, typical_members, with_similarity
from lodestone.llm.mixing import GRID, count_tokens, demand, mix_report, plan_mix, source_targets
from lodestone.llm.queries import p7_clusters
from lodestone.session import durable


def _texts():
    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = list(r.choice(words, 60))
        for c in range(1 + g % 5):
            t = list(base)
            for j in r.choice(60, 3 * c, False):
                t[j] = str(r.choice(words))
            rows.append((f"g{g:02d}c{c}", " ".join(t)))
    return rows + [("copy1", rows[3][1]), ("copy2", rows[3][1].upper()), ("short", "a b c"), ("null", None), ("empty", "")]


def _brute(rows, least=0.5):
    sets = {}
    for k, t in rows:
        w = shingle_words(t or "")
        if len(w) >= 36:
            sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    name = {k: k for k in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
            x, y = sorted((find(a), find(b)))
            name[y] = x
    return {k: find(k) for k in sets}


def test_groups_equal_brute_force(spark):
    rows = _texts()
    df = spark.createDataFrame([(k, t, 1, "n") for k, t in rows] + [("g00c0", "other text", 9, "n"), (None, rows[0][1], 1, "n")], "id string, t string, at int, node string")
    got = alike_groups(df, "id", "t", F.timestamp_seconds("at")).collect()
    mine = {}
    for r in got:
        mine.setdefault(r["component"], []).append(r["id"])
    want = {}
    for k, c in _brute(rows).items():
        want.setdefault(c, []).append(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    assert alike_groups(df.limit(0), "id", "t", F.timestamp_seconds("at")).count() == 0


def test_sets_are_stored_once_and_stay_in_place(spark, monkeypatch):
    rows = [(f"{k}x{i}", t) for k, t in _texts() for i in range(1 + 9 * (k == "g01c0"))]
    df = spark.createDataFrame(rows, "id string, t string").repartition(3)
    raw, nodes = clusters._placed(clusters.shingled(df, "id", "t", F.lit(None)), "id")
    long = {k: frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) for k, t in rows if len(w := shingle_words(t or "")) >= 36}
    assert sorted(r["id"] for r in raw.collect()) == sorted(long) and nodes.count() == len(set(long.values()))
    assert {(r["node"], len(r["grams"])) for r in nodes.collect()} == {(r["node"], len(long[r["id"]])) for r in raw.collect()}
    links = nodes.select(F.col("node").alias("a")).crossJoin(nodes.select(F.col("node").alias("b"))).filter("a < b").repartition(4, "b")
    plan = with_similarity(durable(links), nodes, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the links by b and by a, never the sets
    batch = pa.RecordBatch.from_pydict({"id": ["a", "b", "c", "d"], "t": [rows[0][1], rows[1][1], rows[0][1], rows[0][1]], "o": pa.nulls(4, pa.timestamp("us"))})
    sent = lambda: [r is not None for b in clusters._sets(3, 36)(iter([batch, batch])) for r in b.column(3).to_pylist()]
    assert sent() == [True, True] + 6 * [False]
    monkeypatch.setattr(clusters, "SEEN", 1)
    assert sent() == [True, True, True, False, False, True, True, False]


def test_every_distinct_review_is_in_a_cluster(spark, tmp_path):
    texts = [t for _, t in _texts()] + ["Great place!!", "great place.", "So so", "本日のスープ。", "本日のスープは美味しい。", "x", "!!!", "", None, "one two three four"]
    rows = [(f"r{i}", t, f"2024-01-0{1 + i % 3}") for i, t in enumerate(texts)] + [("r0", "other", "2024-02-01"), (None, "nobody's text", "2024-02-01")]
    spark.createDataFrame(rows, "review_id string, text_cleaned string, at string").selectExpr("review_id", "text_cleaned", "cast(at as timestamp) as loaded_at").write.parquet(f"{tmp_path}/reviews.parquet")
    spark.createDataFrame([("r1", 2)], "review_id string, theme_id int").write.parquet(f"{tmp_path}/review_assignments.parquet")
    got = p7_clusters(spark, str(tmp_path)).collect()
    assert sum(r["reviews"] for r in got) == len(texts) and len({r["cluster_id"] for r in got}) == len(got)
    ids = {t: f"r{i}" for i, t in reversed(list(enumerate(texts)))}
    by = {r["cluster_id"]: r["reviews"] for r in got}
    wordless = sum(not shingle_words(t or "") for t in texts)
    assert by[min(f"r{i}" for i, t in enumerate(texts) if not shingle_words(t or ""))] == wordless == 5
    assert ids["So so"] in by and ids["x"] in by and ids["great place."] not in by


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0)], "a long, b long, similarity double")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_of_chains_with_random_names(spark):
    r = np.random.default_rng(5)
    edges, want = [], {}
    for chain in range(6):
        names = [int(x) for x in r.integers(-(1 << 62), 1 << 62, 300)]
        edges += [(*sorted(p), 1.0) for p in zip(names, names[1:])]
        want |= dict.fromkeys(names, min(names))
    e = spark.createDataFrame(edges, "a long, b long, similarity double")
    assert {x["node"]: x["component"] for x in components(e).collect()} == want
    with pytest.raises(RuntimeError):
        components(e, rounds=2)
    assert components(e.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2_000, 7])
def test_no_alike_pair_is_missed(spark, hot):
    r = np.random.default_rng(3)
    shared = r.choice(1 << 30, 36, False)  # boilerplate: 60 % of each set
    sets = {}
    for g in range(60):
        base = r.integers(1 << 30, 1 << 31, 24)
        for c in range(1 + g % 4):
            own = np.concatenate([base[: 24 - 3 * c], r.integers(1 << 30, 1 << 31, 3 * c)])
            sets[int(r.integers(-(1 << 62), 1 << 62))] = {int(x) for x in np.concatenate([shared, own])}
    for c in range(40):  # similarities around a half, without boilerplate; sizes differ
        base = r.integers(0, 1 << 31, 40 + c)
        for keep in (1.0, 0.8, 0.67, 0.6, 0.5):
            sets[int(r.integers(-(1 << 62), 1 << 62))] = {int(x) for x in base[: int(keep * len(base))]}
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(sets.items(), 2) if len(x & y) / len(x | y) >= 0.5}
    nodes = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "node long, grams array<int>")
    links = prefix_links(nodes, 0.5, hot)
    assert {(x["a"], x["b"]) for x in with_similarity(links, nodes, 0.5).collect()} == want
    assert links.count() < 3 * len(want)


def test_communities(spark):
    edges = [(a, b, 1.0) for c in (0, 10, 20) for a, b in combinations(range(c, c + 6), 2)] + [(0, 10, 0.1), (10, 20, 0.1)]
    e = spark.createDataFrame(edges, "a long, b long, similarity double")
    m = communities(e, rounds=6, levels=2)
    groups = {}
    for r in m.collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(c, c + 6)) for c in (0, 10, 20)]
    assert modularity(e, m) > 0.6
    top = typical_members(e, m, 1).collect()
    assert {r["node"] for r in top} == {0, 10, 20} or all(r["weight"] == pytest.approx(5.0) for r in top)
    assert communities(e.limit(0)).count() == 0


def test_demand_meets_targets():
    d = demand({"a": 1.0, "b": 3.0}, 1000, {"a": [(0.0, 0.0), (1.0, 2.0)]})
    assert d["a"][-1] == pytest.approx(250) and d["b"][-1] == pytest.approx(750)
    assert d["a"][GRID // 2] < 125 and (np.diff(d["a"]) >= 0).all()


def test_mix(spark):
    sizes = {"Big Source": (200, 10), "big-source": (100, 10), "small": (10, 10), None: (50, 10), "unlisted": (40, 10)}
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, (c, n) in sizes.items() for _ in range(c))]
    t = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, tokens long, epoch int")
    w = spark.createDataFrame([("big_source", 3.0, 1), ("small", 1.0, 4), (None, 5.0, 1), ("absent", 1.0, 9)], "source string, weight double, max_repeats int")
    targets = source_targets(t, w)
    by = {r["source"]: r for r in targets.collect()}
    assert set(by) == {"big_source", "small", "absent"}
    assert by["big_source"]["target"] == pytest.approx(2400) and not by["big_source"]["short"]
    assert by["small"]["available"] == 400 and by["small"]["short"] and by["absent"]["short"]
    for buckets in (1, 8, 1024):
        plan = plan_mix(t, "doc_id", targets, buckets=buckets)
        got = plan.collect()
        assert sum(r["tokens"] for r in got if r["source"] == "big_source") == 2400
        small = [r for r in got if r["source"] == "small"]
        assert len(small) == 40 and max(r["epoch"] for r in small) == 3
        assert all(0 <= r["position"] <= 1 for r in got)
    rep = {r["source"]: r for r in mix_report(plan, targets).collect()}
    assert rep["small"]["repeats"] == 4 and rep["absent"]["used_tokens"] == 0 and sum(r["actual_share"] for r in rep.values()) == pytest.approx(1)
    assert plan_mix(t, "doc_id", source_targets(t, w.limit(0))).count() == 0
    assert source_targets(t.limit(0), w).filter("short").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "word " * 20_000), (5, "x" * 50_000)], "doc_id long, text string")
    n = {r["doc_id"]: r["tokens"] for r in count_tokens(df, "text").collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and 20_000 <= n[4] <= 20_010 and n[5] > 1000
