"""Missing values, ties, integer columns and counts beyond 2**31.5."""

import math

import numpy as np
from pyspark.sql import functions as F

from demandflow.operators import arima as AR
from demandflow.operators import clean as CL
from demandflow.operators import cluster as C
from demandflow.operators import dbscan as DB
from demandflow.operators import models as MO
from demandflow.operators import profile as P
from demandflow.operators import select as SE
from demandflow.operators import series as S


def test_integer_mean_is_not_cut(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert sorted(r.v for r in CL.impute_mean(df).collect()) == [1.0, 1.5, 2.0]


def test_nan_and_empty_columns_are_missing(spark):
    df = spark.createDataFrame([(float(x), None, x) for x in (1, 2, 3, 4)] + [(math.nan, None, 5)], "v double, none double, k int")
    out = {r["column"]: r for r in CL.iqr_outliers(df, ["v", "none"]).collect()}
    assert out["v"].n_outliers == 0 and out["none"].n_outliers == 0 and out["none"].q1 is None
    capped = CL.cap_outliers(df, ["v", "none"]).orderBy("k").collect()
    assert capped[-1].v is None and all(r.none is None for r in capped)
    stats = {r["column"]: r for r in P.describe(df, ["v", "none"]).collect()}
    assert stats["v"]["count"] == 4 and stats["v"]["mean"] == 2.5
    assert stats["none"]["count"] == 0 and stats["none"]["mean"] is None
    assert [r.v for r in CL.impute_mean(df, ["v", "none"]).orderBy("k").collect()][-1] == 2.5


def test_clustering_keeps_rows_with_missing_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (math.nan, 1.0), (4.0, None), (2.0, 2.0)], "a double, b double")
    assert C.scaled_vectors(df, ["a", "b"]).count() == 5
    assert C.pca_project(df, ["a", "b"]).count() == 5


def test_adjusted_rand_of_large_counts(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1)], "a int, b int")
    assert C.adjusted_rand(df, "a", "b").first().ari == 1.0
    # counts enter the product as doubles: a product of longs overflows above 3.04e9 rows
    plan = C.adjusted_rand(df, "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "as double) * (cast(" in plan


def test_tied_times_do_not_depend_on_row_order(spark):
    rows = [("s", i // 2, float(i)) for i in range(60)]
    got = []
    for order in (rows, rows[::-1]):
        for chunk in (1_000, 12):
            df = spark.createDataFrame(order, "series string, t int, y double")
            out = S.lag_features(df, "series", "t", "y", lags=(1,), chunk_rows=chunk, bucket_width=4)
            got.append(sorted((r.t, r.y, r.y_lag1) for r in out.withColumn("y_lag1", F.coalesce("y_lag1", F.lit(-1.0))).collect()))
    assert all(g == got[0] for g in got)


def test_stacking_keeps_single_rows_of_tied_times(spark):
    rng = np.random.default_rng(1)
    rows = [("s", i // 2, float(a), float(b), float(2 * a - b + 5)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "series string, ts int, a double, b double, demand double")
    data = MO.design(S.chrono_split(df, "series", "ts"), ["a", "b"])
    out = MO.stacking(data, ["linear", "ridge"], keys=("series",), ts="ts").collect()
    assert len(out) == 120
    assert max(abs(r.predicted - r.demand) for r in out if r.split == "test") < 0.2


def test_chunked_arima_equals_one_pass(spark):
    rng = np.random.default_rng(4)
    e, d = rng.normal(size=1201), np.zeros(1201)
    for i in range(1, 1201):
        d[i] = 0.5 * d[i - 1] + e[i] + 0.3 * e[i - 1]
    y = np.cumsum(d)
    assert np.allclose(AR.fit_css(y), AR.fit_css(y, chunk_rows=100))
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)] + [("t", i, float(i)) for i in range(3)], "k string, t int, y double")
    got = {r.k: r for r in AR.fit_arima(df, "k", "t", "y", train_frac=1.0, chunk_rows=250).collect()}
    want = AR.fit_css(y)
    assert got["s"].n_train == 1201 and np.allclose([got["s"].phi, got["s"].theta, got["s"].sigma2], want)
    assert abs(got["s"].phi - 0.5) < 0.1 and abs(got["s"].theta - 0.3) < 0.1
    assert (got["t"].phi, got["t"].theta) == (0.0, 0.0) and got["t"].sigma2 is None


def test_dbscan_with_one_dense_cell(spark):
    """20,000 points in one cell, a ring of sparse points around them, a far group and noise."""
    rng = np.random.default_rng(8)
    dense = rng.uniform(0.01, 0.3, (20_000, 2))
    ring = np.stack([0.55 + rng.uniform(0, 0.3, 40), rng.uniform(0, 0.4, 40)], axis=1)
    far = rng.uniform(10, 10.3, (30, 2))
    x = np.concatenate([dense, ring, far, [[50.0, 50.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    got = {r.id: (r.label, r.is_core) for r in DB.dbscan(df, "id", ["a", "b"], 0.45, 6).collect()}
    near = lambda p: ((x - p) ** 2).sum(1) <= 0.45 ** 2
    core = {i: near(x[i]).sum() >= 6 for i in range(20_000, len(x))}
    assert all(got[i] == (0, True) for i in range(20_000)) and all(got[i][1] == c for i, c in core.items())
    assert all(got[i][0] == 0 for i in range(20_000, 20_040)) and all(got[i][0] == 1 for i in range(20_040, 20_070))
    assert got[20_070] == (-1, False)


def test_kmeans_cost_falls_and_centres_are_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for c in ((0, 0), (5, 5), (0, 8)) for a, b in rng.normal(c, 0.5, (60, 2))]
    vec = C.cached_vectors(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    models = [C.kmeans_best(vec, k, n_init=2) for k in (2, 3, 4)]
    costs = [m.summary.trainingCost for m in models]
    assert costs == sorted(costs, reverse=True)
    centres = np.array(models[1].clusterCenters())
    for r in models[1].transform(vec).select(C.VEC, "cluster").collect():
        assert ((centres - r[0].toArray()) ** 2).sum(1).argmin() == r[1]


def test_only_eligible_series_are_kept(spark):
    df = spark.createDataFrame([("a", i) for i in range(60)] + [("b", i) for i in range(5)], "series string, v int")
    assert {r.series for r in SE.keep_eligible(df, "series", 50).collect()} == {"a"}
    assert SE.sample_rows(df, 10).count() == 10
