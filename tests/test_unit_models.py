"""Clustering and model operators against numpy references and invariants."""

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from demandflow.operators import arima as AR
from demandflow.operators import cluster as C
from demandflow.operators import dbscan as DB
from demandflow.operators import models as MO


def _blobs(spark, seed=0):
    rng = np.random.default_rng(seed)
    X = np.vstack([rng.normal((0, 0), 0.3, (40, 2)), rng.normal((4, 0), 0.3, (40, 2)),
                   rng.normal((0, 4), 0.3, (40, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)],
                               "id long, a double, b double")
    return X, df


def test_silhouette_sq_equals_clustering_evaluator(spark):
    _, df = _blobs(spark)
    vec = C.scaled_vectors(df, ["a", "b"])
    lab = C.kmeans_best(vec, 3, n_init=2).transform(vec)
    ours = C.silhouette_sq(lab, "cluster").first()["silhouette"]
    ref = ClusteringEvaluator(featuresCol=C.VEC, predictionCol="cluster",
                              distanceMeasure="squaredEuclidean").evaluate(lab)
    assert math.isclose(ours, ref, rel_tol=1e-9)


def test_kmeans_assigns_nearest_centre(spark):
    _, df = _blobs(spark)
    vec = C.scaled_vectors(df, ["a", "b"]).persist()
    m = C.kmeans_best(vec, 3, n_init=3)
    centres = np.array(m.clusterCenters())
    for r in m.transform(vec).collect():
        x = r[C.VEC].toArray()
        assert r["cluster"] == int(np.argmin(((centres - x) ** 2).sum(1)))


def test_adjusted_rand_identity_and_permutation(spark):
    df = spark.createDataFrame([(i % 3, (i % 3 + 1) % 3) for i in range(30)], "a int, b int")
    assert math.isclose(C.adjusted_rand(df, "a", "b").first()["ari"], 1.0)
    rnd = spark.createDataFrame([(i % 2, i % 3) for i in range(60)], "a int, b int")
    assert C.adjusted_rand(rnd, "a", "b").first()["ari"] < 0.1


def test_pca_variance_matches_numpy(spark):
    X, df = _blobs(spark)
    Z = (X - X.mean(0)) / X.std(0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(Z.T)))[::-1]
    got = [r["ratio"] for r in C.pca_variance(df, ["a", "b"]).orderBy("component").collect()]
    assert np.allclose(got, ev / ev.sum(), atol=1e-9)


def test_ward_recovers_blobs(spark):
    X, df = _blobs(spark)
    out, merges = C.ward_cluster(df, ["a", "b"], n_clusters=3, micro=256, keep=["id"])
    lab = {r["id"]: r["ward_cluster"] for r in out.collect()}
    truth = np.repeat([0, 1, 2], 40)
    got = np.array([lab[i] for i in range(len(X))])
    # the same partition (labels may be permuted)
    assert len({(t, g) for t, g in zip(truth, got)}) == 3 and len(set(got)) == 3
    assert merges.count() == len(X) - 1


def test_ward_merge_heights_match_bruteforce():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 2))
    merges = C.ward_merges_local(x, np.ones(12))
    heights = [h for _, _, h, _ in merges]
    assert all(b >= a - 1e-12 for a, b in zip(heights, heights[1:]))   # Ward is monotone
    assert merges[-1][3] == 12


def _brute_dbscan(X, eps, ms):
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    N = D <= eps
    core = N.sum(1) >= ms
    lab = -np.ones(len(X), int)
    c = 0
    for i in range(len(X)):
        if lab[i] != -1 or not core[i]:
            continue
        lab[i] = c
        stack = [i]
        while stack:
            p = stack.pop()
            for q in np.where(N[p])[0]:
                if lab[q] == -1:
                    lab[q] = c
                    if core[q]:
                        stack.append(q)
        c += 1
    return lab


@pytest.mark.parametrize("seed", [1, 2])
def test_dbscan_equals_bruteforce(spark, seed):
    rng = np.random.default_rng(seed)
    X = np.vstack([rng.normal((0, 0), 0.4, (60, 2)), rng.normal((3, 0), 0.4, (60, 2)),
                   rng.uniform(-2, 5, (30, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)],
                               "id long, a double, b double")
    out = {r["id"]: r["label"] for r in DB.dbscan(df, "id", ["a", "b"], 0.45, 6).collect()}
    assert (np.array([out[i] for i in range(len(X))]) == _brute_dbscan(X, 0.45, 6)).all()


def test_dense_index(spark):
    df = spark.createDataFrame([(v,) for v in [5, 3, 3, 9, 1, 5]], "v int").repartition(3)
    got = sorted((r["v"], r["idx"]) for r in DB.dense_index(df, "v").collect())
    assert got == [(1, 0), (3, 1), (5, 2), (9, 3)]


def test_arima_css_recovers_parameters():
    rng = np.random.default_rng(7)
    n, phi, theta = 3000, 0.5, 0.3
    e = rng.normal(size=n)
    d = np.zeros(n)
    for t in range(1, n):
        d[t] = phi * d[t - 1] + e[t] + theta * e[t - 1]
    y = np.cumsum(d) + 100
    p, q, _ = AR.fit_css(y)
    assert abs(p - phi) < 0.05 and abs(q - theta) < 0.05


def test_arima_closed_form_equals_recursion(spark):
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=60)) + 50
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "series string, t long, y double")
    params = spark.createDataFrame([("s", 0.4, -0.2)], "series string, phi double, theta double")
    fc = AR.arima_forecast(df, "series", "t", "y", params).orderBy("t").collect()
    # recursion on the 48 train rows
    tr = y[:48]
    d = np.diff(tr)
    e, prev = 0.0, 0.0
    for x in d:
        e = x - 0.4 * prev - (-0.2) * e
        prev = x
    level, dl, el = tr[-1], d[-1], e
    for r in fc:
        dn = 0.4 * dl + (-0.2) * el
        level, dl, el = level + dn, dn, 0.0
        assert math.isclose(r["forecast"], level, rel_tol=1e-9)


def test_linear_and_ridge_match_normal_equations(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(200, 3))
    y = X @ np.array([1.5, -2.0, 0.5]) + 3 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t), "train")
                                for (a, b, c), t in zip(X, y)],
                               "a double, b double, c double, demand double, split string")
    data = MO.design(df, ["a", "b", "c"])
    Z = (X - X.mean(0)) / X.std(0)
    A = np.hstack([Z, np.ones((200, 1))])
    for name, alpha in (("linear", 0.0), ("ridge", 1.0)):
        model, _ = MO.fit_predict(data, name)
        pen = np.diag([alpha] * 3 + [0.0])
        w = np.linalg.solve(A.T @ A + pen, A.T @ y)
        assert np.allclose(model.coefficients.toArray(), w[:3], atol=1e-6)
        assert math.isclose(model.intercept, w[3], abs_tol=1e-6)


def test_assign_nearest_and_centroids(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 0.0]), (1, 0, [0.2, 0.0]), (2, 1, [5.0, 5.0]),
                                (3, 1, [4.0, 5.0]), (4, 1, [0.5, 0.1])],
                               "id int, label int, v array<double>")
    cen = C.label_centroids(df, "label", "v")
    out = {r["id"]: r["nearest"] for r in C.assign_nearest(df, "v", cen, "label").collect()}
    assert out == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0}


def test_unknown_model_name():
    with pytest.raises(ValueError):
        MO.make_estimator("prophet")


def test_stacking_out_of_fold_and_accuracy(spark):
    rng = np.random.default_rng(2)
    n = 120
    X = rng.normal(size=(n, 2))
    y = X @ np.array([2.0, -1.0]) + 5 + rng.normal(scale=0.05, size=n)
    rows = [("s", i, float(a), float(b), float(t), "train" if i < 96 else "test")
            for i, ((a, b), t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "series string, ts long, a double, b double, demand double, "
                                     "split string")
    data = MO.design(df, ["a", "b"])
    pred = MO.stacking(data, ["linear", "ridge"], keys=["series"], ts="ts")
    test = pred.where("split = 'test'").select("demand", "predicted").toPandas()
    assert len(test) == 24
    assert np.abs(test["demand"] - test["predicted"]).mean() < 0.2
