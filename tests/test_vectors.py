import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import clustering as cl
from lodestone.operators import vectors as ve


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 8))
    return x / np.linalg.norm(x, axis=1, keepdims=True), r.integers(0, 4, 60)


@pytest.fixture(scope="module")
def frame(spark, points):
    x, c = points
    return spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c))], "id long, embedding array<float>, label int")


def test_sums_equal_pairs(frame, points):
    x, c = points
    for r in ve.intra_cosine(frame, "label").collect():
        m = x[c == r["label"]]
        s = m @ m.T
        assert r["intra"] == pytest.approx(s[np.triu_indices(len(m), 1)].mean(), abs=1e-5)
    for r in ve.consistency(frame, "label").collect():
        m = x[c == r["label"]]
        assert r["consistency"] == pytest.approx((m @ m.T).mean(), abs=1e-5)


def test_neighbours_equal_brute_force(frame, points):
    x, _ = points
    got = ve.top_neighbours(frame, frame.filter("id % 7 = 0"), "id", k=4).collect()
    for q in range(0, 60, 7):
        s = x @ x[q]
        s[q] = -9
        assert [r["id"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == list(np.argsort(-s)[:4])


def test_links_and_removal(spark):
    v = {0: [1.0, 0.0], 1: [0.9, 0.436], 2: [0.62, 0.785], 3: [-1.0, 0.0], 4: [0.0, 0.0], 5: None}
    df = spark.createDataFrame(list(v.items()), "id long, embedding array<float>")
    links = ve.similar_links(df, "id", threshold=0.85)
    assert sorted((r["a"], r["b"]) for r in links.collect()) == [(0, 1), (1, 2)]
    assert sorted(r[0] for r in ve.keep_first_near_duplicates(df, "id", links).select("id").collect()) == [0, 2, 3, 4, 5]
    assert sorted(r[0] for r in ve.drop_near_duplicates(df, "id", links).select("id").collect()) == [3, 4, 5]
    assert {r["id"]: r["links"] for r in ve.link_counts(df, "id", links).collect()} == {0: 1, 1: 2, 2: 1, 3: 0, 4: 0, 5: 0}


def test_whitened_columns_have_variance_one(frame):
    w = np.array([r[0] for r in ve.whiten(frame, k=5).select("whitened").collect()])
    assert w.shape == (60, 5)
    assert np.allclose(np.cov(w.T), np.eye(5), atol=1e-6)


def test_empty(spark, frame):
    e = frame.limit(0)
    assert ve.similar_links(e, "id").count() == 0
    assert ve.silhouette(e, "id", "label").count() == 0
    assert ve.top_neighbours(e, e, "id").count() == 0
    assert ve.centroids(e, "label").count() == 0


def _brute_linkage(x):
    groups = {i: [i] for i in range(len(x))}
    d = 1 - x @ x.T
    out = []
    while len(groups) > 1:
        h, a, b = min((d[np.ix_(groups[a], groups[b])].mean(), a, b) for a in groups for b in groups if a < b)
        out.append(h)
        groups[a] += groups.pop(b)
    return sorted(out)


def test_linkage_equals_brute_force(points):
    m = cl.average_linkage(points[0])
    assert np.allclose(m[:, 2], _brute_linkage(points[0]), atol=1e-9)
    assert m[-1, 3] == 60
    for k in (1, 3, 60):
        assert len(set(cl.cut_labels(m, 60, k=k))) == k
    assert len(set(cl.cut_labels(m, 60, height=0.0))) == 60


def test_cut_height():
    assert cl.cut_height([0.1, 0.2, 0.3, 0.9, 1.0]) == 0.2
    assert cl.cut_height([0.5]) == 0.5
    assert cl.cut_height([0.1, 0.2, 0.3, 0.9, 1.0], legacy_offset=True) == 0.1


def test_context_and_main(spark, frame):
    labels = cl.context_labels(frame.withColumn("g", F.lit(1)), "g", "id", k=3)
    assert labels.count() == 60 and labels.select("label").distinct().count() == 3
    main = cl.main_context(labels, "g").collect()
    sizes = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    assert len(main) == max(sizes.values())


def test_kmeans(frame):
    labelled, model = cl.fit_kmeans(frame, 4)
    assert labelled.select("label").distinct().count() <= 4 and len(model.clusterCenters()) == 4
    with pytest.raises(ValueError, match="unknown method"):
        cl.fit_kmeans(frame, 2, method="agglo")


def test_elbow_is_the_same_for_distances(spark):
    ys = (0.42, 0.48, 0.53, 0.57, 0.61, 0.63, 0.65, 0.66, 0.67)
    for flip in (False, True):
        curve = spark.createDataFrame([(k, 1 - y if flip else y) for k, y in zip(range(6, 15), ys)], "k int, y double")
        assert cl.elbow(curve, "k", "y").filter("selected").first()["k"] == 10
