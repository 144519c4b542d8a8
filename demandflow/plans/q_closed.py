"""Model queries whose answer has a closed form, so that SQL can check the fit:
PCA of two columns, linear and ridge regression on two features, stacking folds,
and the scaler's inverse (C1-C4, W5, M1, M2, M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.scalars import r6, ts_text
from demandflow.operators import cluster as C
from demandflow.operators import features as FE
from demandflow.operators import models as MO
from demandflow.operators import series as S
from demandflow.plans import forecast as FC
from demandflow.plans import sqlgen as G
from demandflow.plans import views as V
from demandflow.plans.catalog import query
from demandflow.plans.q_forecast import PRED_CTES

PAIR = ["temperature", "windSpeed"]       # correlated in every size, with a positive sign

# Two standardised columns with correlation r have the variances 1 + |r| and 1 - |r|
# and, for r > 0, the first component (z0 + z1) / sqrt(2).
PAIR_CTES = [("r", f"SELECT corr({PAIR[0]}, {PAIR[1]}) AS r FROM w")]


@query("pca_two_variance", V.with_views(
    """SELECT component, round(ratio, 6) AS ratio, round(cumulative, 6) AS cumulative,
              CASE WHEN (1 + abs(r)) / 2 >= 0.85 THEN 1 ELSE 2 END AS k_for_threshold
       FROM (SELECT 1 AS component, (1 + abs(r)) / 2 AS ratio, (1 + abs(r)) / 2 AS cumulative, r FROM r
             UNION ALL SELECT 2, (1 - abs(r)) / 2, 1.0, r FROM r)""", "w", ctes=PAIR_CTES))
def q_pca_two_variance(spark, sf):
    out = C.pca_variance(V.weather(spark, sf), PAIR, 0.85)
    return out.withColumns({c: r6(c) for c in ("ratio", "cumulative")})


@query("pca_two_projection", V.with_views(
    f"""SELECT series, {G.ts_text('ts')} AS ts,
           round(((a - avg(a) OVER ()) / stddev_pop(a) OVER () + (b - avg(b) OVER ()) / stddev_pop(b) OVER ()) / sqrt(2), 6) AS PC1
       FROM (SELECT series, ts, {PAIR[0]} AS a, {PAIR[1]} AS b FROM w)""", "w"))
def q_pca_two_projection(spark, sf):
    out = C.pca_project(V.weather(spark, sf), PAIR, k=1, keep=["series", "ts"])
    return out.select("series", ts_text("ts").alias("ts"), r6("PC1").alias("PC1"))


@query("pca_two_loading", f"""SELECT feature, 1 AS component, round(1 / sqrt(2), 6) AS loading
       FROM (VALUES ('{PAIR[0]}'), ('{PAIR[1]}')) t(feature)""")
def q_pca_two_loading(spark, sf):
    return C.pca_loadings(V.weather(spark, sf), PAIR, k=1).withColumn("loading", r6("loading"))


@query("unstandardize", V.with_views(
    f"""SELECT series, {G.ts_text('ts')} AS ts, {', '.join(f'round({c}, 6) AS {c}' for c in G.CLUSTER_FEATURES)} FROM w""", "w"))
def q_unstandardize(spark, sf):
    """Standardising and its inverse give the rows back."""
    w = V.weather(spark, sf)
    cols = G.CLUSTER_FEATURES
    stats = FE.scaler_stats(w, cols)
    out = FE.unstandardize(FE.standardize(w, cols, stats), cols, stats)
    return out.select("series", ts_text("ts").alias("ts"), *[r6(c).alias(c) for c in cols])


@query("stacking_folds", V.with_views(
    f"""SELECT series, {G.ts_text('ts')} AS ts,
          CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
                    ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
        FROM (SELECT series, ts, rn AS i, CAST(floor(cnt * 0.8) AS BIGINT) AS n FROM fs WHERE rn < floor(cnt * 0.8))""",
    "h", ctes=PRED_CTES))
def q_stacking_folds(spark, sf):
    rows, _ = FC.complete_rows(V.hourly(spark, sf))
    train = S.chrono_split(rows, "series", "ts").where(F.col("split") == "train")
    out = S.stacking_folds(train, "series", "ts", 5)
    return out.select("series", ts_text("ts").alias("ts"), "fold")


TWO = ["demand_lag1", "demand_lag24"]


def _two_feature_sql(alpha: float) -> str:
    """Normal equations of two standardised features over the pooled train rows, with
    ``alpha`` on the diagonal; predictions of the test rows."""
    return V.with_views(f"""SELECT series, {G.ts_text('ts')} AS ts, round(my
             + ((n + {alpha}) * y1 - n * r * y2) / ((n + {alpha}) * (n + {alpha}) - n * r * n * r) * (l1 - m1) / s1
             + ((n + {alpha}) * y2 - n * r * y1) / ((n + {alpha}) * (n + {alpha}) - n * r * n * r) * (l24 - m2) / s2, 4) AS predicted
        FROM fs, st WHERE rn >= floor(cnt * 0.8)""", "h", ctes=PRED_CTES + [
        ("st", """SELECT count(*)::DOUBLE AS n, avg(l1) AS m1, avg(l24) AS m2, stddev_pop(l1) AS s1, stddev_pop(l24) AS s2,
                  avg(demand) AS my, corr(l1, l24) AS r, count(*) * covar_pop(l1, demand) / stddev_pop(l1) AS y1,
                  count(*) * covar_pop(l24, demand) / stddev_pop(l24) AS y2 FROM fs WHERE rn < floor(cnt * 0.8)""")])


def _two_features(spark, sf, name):
    rows, bound = FC.complete_rows(V.hourly(spark, sf))
    data = MO.design(S.chrono_split(rows, "series", "ts", max_rows=bound), TWO)
    _, pred = MO.fit_predict(data, name)
    test = pred.where(F.col("split") == "test")
    return test.select("series", ts_text("ts").alias("ts"), F.round("predicted", 4).alias("predicted"))


@query("linear_two_features", _two_feature_sql(0.0))
def q_linear_two_features(spark, sf):
    return _two_features(spark, sf, "linear")


@query("ridge_two_features", _two_feature_sql(1.0))
def q_ridge_two_features(spark, sf):
    return _two_features(spark, sf, "ridge")
