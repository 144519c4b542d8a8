"""Forecast and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.scalars import r6
from demandflow.functions.scalars import ts_text
from demandflow.operators import arima as AR
from demandflow.operators import metrics as M
from demandflow.plans import forecast as FC
from demandflow.plans import sqlgen as G
from demandflow.plans import views as V
from demandflow.plans.catalog import query
from demandflow.plans.forecast import naive_forecast_metrics

METRIC_COLS = ["n", "mae", "rmse", "r2", "mape", "mean_actual"]


def rounded(df, cols):
    return df.withColumns({c: r6(c) for c in cols})


# --- SQL pieces shared by the oracles ------------------------------------------

FEATURES_SQL = """SELECT series, ts, demand,
       lag(demand, 1) OVER w AS demand_lag1,
       lag(demand, 24) OVER w AS demand_lag24,
       avg(demand) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS demand_roll6_mean,
       coalesce(stddev_samp(demand) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS demand_roll6_std,
       avg(demand) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS demand_roll12_mean,
       coalesce(stddev_samp(demand) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 0) AS demand_roll12_std,
       avg(demand) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS demand_roll24_mean,
       coalesce(stddev_samp(demand) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 0) AS demand_roll24_std
FROM h WINDOW w AS (PARTITION BY series ORDER BY ts)"""

SPLIT_SQL = """SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS rn,
       count(*) OVER (PARTITION BY series) AS cnt
FROM f WHERE demand_lag1 IS NOT NULL AND demand_lag24 IS NOT NULL"""


def metrics_sql(src: str, keys: str, y: str, p: str, rnd: bool = True) -> str:
    """Oracle twin of ``regression_metrics`` (rounded unless ``rnd`` is off)."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""

    def r(e):
        return f"round({e}, 6)" if rnd else f"({e})"
    return f"""SELECT {k}count(*) AS n,
       {r(f"avg(abs({p} - {y}))")} AS mae,
       {r(f"sqrt(avg(({p} - {y}) * ({p} - {y})))")} AS rmse,
       {r(f"""CASE WHEN var_pop({y}) * count(*) = 0
                  THEN CASE WHEN sum(({p} - {y}) * ({p} - {y})) = 0 THEN 1.0 ELSE 0.0 END
                  ELSE 1 - sum(({p} - {y}) * ({p} - {y})) / (var_pop({y}) * count(*)) END""")} AS r2,
       {r(f"avg(abs({p} - {y}) / nullif(abs({y}), 0)) * 100")} AS mape,
       {r(f"avg({y})")} AS mean_actual
FROM {src} WHERE {y} IS NOT NULL AND {p} IS NOT NULL {g}"""


# --- flagship ----------------------------------------------------------------------

@query("naive_forecast_metrics", V.with_views(
    metrics_sql("t", "series", "demand", "demand_lag24"), "h",
    ctes=[("f", FEATURES_SQL), ("s", SPLIT_SQL),
          ("t", "SELECT * FROM s WHERE rn >= floor(cnt * 0.8::DOUBLE)")]))
def q_naive_forecast_metrics(spark, sf):
    out = naive_forecast_metrics(V.hourly(spark, sf))
    return rounded(out, METRIC_COLS)


# --- forecasters over the test rows (W6, E1-E6, U1, O2-O4, J3) -------------------

PRED_CTES = [
    ("fp", """SELECT series, ts, demand,
        lag(demand, 1) OVER w AS l1, lag(demand, 24) OVER w AS l24, lag(demand, 168) OVER w AS l168,
        avg(demand) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m24
        FROM h WINDOW w AS (PARTITION BY series ORDER BY ts)"""),
    ("fs", """SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS rn,
        count(*) OVER (PARTITION BY series) AS cnt FROM fp
        WHERE l1 IS NOT NULL AND l24 IS NOT NULL AND l168 IS NOT NULL AND m24 IS NOT NULL"""),
    ("pred", G.union_all([
        f"SELECT series, ts, demand AS actual, '{m}' AS model, {c} AS predicted FROM fs "
        "WHERE rn >= floor(cnt * 0.8)"
        for m, c in [("naive", "l24"), ("last_value", "l1"), ("weekly", "l168"), ("mean24", "m24")]])),
    ("mu", metrics_sql("pred", "series, model", "actual", "predicted", rnd=False)),
]

NORM_SQL = """SELECT *,
   1 - least(1, mae / nullif(mean_actual * 0.3, 0)) AS mae_norm,
   1 - least(1, rmse / nullif(mean_actual * 0.4, 0)) AS rmse_norm,
   CASE WHEN r2 < 0 THEN (r2 + 1) / 2 ELSE r2 END AS r2_norm,
   CASE WHEN mape IS NULL THEN 0.5 ELSE 1 - least(1, mape / 100) END AS mape_norm
FROM mu"""

# Weights of the score, its grades and their limits.
SCORE_SQL = """SELECT *, mae_norm * 0.3 + rmse_norm * 0.3 + r2_norm * 0.3 + mape_norm * 0.1 AS performance_score
FROM nm"""

GRADE_SQL = """CASE WHEN performance_score >= 0.9 THEN 'Excellent' WHEN performance_score >= 0.75 THEN 'Good'
     WHEN performance_score >= 0.6 THEN 'Satisfactory' WHEN performance_score >= 0.4 THEN 'Fair'
     ELSE 'Poor' END"""


def _r6_sql(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def _metrics(spark, sf):
    pred = FC.forecaster_predictions(V.hourly(spark, sf))
    return M.regression_metrics(pred, ["series", "model"], "actual", "predicted")


@query("regression_metrics", V.with_views(
    f"SELECT series, model, n, {_r6_sql(METRIC_COLS[1:])} FROM mu", "h", ctes=PRED_CTES))
def q_regression_metrics(spark, sf):
    return rounded(_metrics(spark, sf), METRIC_COLS[1:])


IMP = ["mae_improvement", "rmse_improvement", "mape_improvement"]


@query("improvement_over_baseline", V.with_views(
    f"""SELECT m.series, m.model, {', '.join(f'round(m.{c}, 6) AS {c}' for c in ('mae', 'rmse', 'mape'))},
           {', '.join(f'round((b.{c} - m.{c}) / nullif(b.{c}, 0) * 100, 6) AS {c}_improvement'
                      for c in ('mae', 'rmse', 'mape'))}
        FROM mu m LEFT JOIN (SELECT * FROM mu WHERE model = 'naive') b USING (series)""",
    "h", ctes=PRED_CTES))
def q_improvement_over_baseline(spark, sf):
    m = _metrics(spark, sf)
    base = m.where(F.col("model") == FC.BASELINE)
    out = M.improvement_over_baseline(m.select("series", "model", "mae", "rmse", "mape"),
                                      base, keys=["series"])
    return rounded(out, ["mae", "rmse", "mape", *IMP])


NORMS = ["mae_norm", "rmse_norm", "r2_norm", "mape_norm"]


@query("normalized_metrics", V.with_views(
    f"SELECT series, model, {_r6_sql(NORMS)} FROM nm", "h", ctes=PRED_CTES + [("nm", NORM_SQL)]))
def q_normalized_metrics(spark, sf):
    out = M.normalized_metrics(_metrics(spark, sf))
    return rounded(out.select("series", "model", *NORMS), NORMS)


@query("performance_score", V.with_views(
    f"""SELECT series, model, round(performance_score, 6) AS performance_score,
               {GRADE_SQL} AS performance_grade FROM sc""", "h",
    ctes=PRED_CTES + [("nm", NORM_SQL), ("sc", SCORE_SQL)]))
def q_performance_score(spark, sf):
    out = M.performance_score(M.normalized_metrics(_metrics(spark, sf)))
    return rounded(out.select("series", "model", "performance_score", "performance_grade"),
                   ["performance_score"])


@query("forecast_points", V.with_views(
    """SELECT series, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date, actual, predicted
       FROM pred WHERE model = 'naive'""", "h", ctes=PRED_CTES))
def q_forecast_points(spark, sf):
    pred = FC.forecaster_predictions(V.hourly(spark, sf)).where(F.col("model") == FC.BASELINE)
    return M.forecast_points(pred, "series")


@query("align_predictions", V.with_views(
    f"""SELECT h.series, {G.ts_text('h.ts')} AS ts, h.demand AS actual, p.predicted
        FROM h LEFT JOIN (SELECT * FROM pred WHERE model = 'naive') p USING (series, ts)""",
    "h", ctes=PRED_CTES))
def q_align_predictions(spark, sf):
    h = V.hourly(spark, sf)
    pred = (FC.forecaster_predictions(h).where(F.col("model") == FC.BASELINE)
            .select("series", "ts", "predicted"))
    out = M.align_predictions(h, pred, ["series", "ts"])
    return out.select("series", ts_text("ts").alias("ts"), F.col("demand").alias("actual"),
                      "predicted")


# --- ARIMA forecast from given parameters (M7, SQL form) ------------------------

ARIMA_PHI, ARIMA_THETA = 0.5, 0.3

ARIMA_CTES = [
    ("ai", """SELECT series, ts, demand, demand - lag(demand, 1) OVER w AS d,
        lag(demand, 1) OVER w - lag(demand, 2) OVER w AS dprev,
        row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY series) AS cnt
        FROM (SELECT series, ts, demand FROM fs) WINDOW w AS (PARTITION BY series ORDER BY ts)"""),
    ("ast", f"""SELECT series, arg_max(demand, rn) AS yT, arg_max(d, rn) AS dT,
        sum(CASE WHEN rn >= 1 THEN pow(-{ARIMA_THETA}, floor(cnt * 0.8) - 1 - rn)
                 * (d - {ARIMA_PHI} * coalesce(dprev, 0)) END) AS eT
        FROM ai WHERE rn < floor(cnt * 0.8) GROUP BY series"""),
    ("af", f"""SELECT series, ts, CAST(rn - (floor(cnt * 0.8) - 1) AS BIGINT) AS h, demand AS actual,
        yT + ({ARIMA_PHI} * coalesce(dT, 0) + {ARIMA_THETA} * coalesce(eT, 0))
           * (1 - pow({ARIMA_PHI}, rn - (floor(cnt * 0.8) - 1))) / (1 - {ARIMA_PHI}) AS forecast
        FROM ai JOIN ast USING (series) WHERE rn >= floor(cnt * 0.8)"""),
]


def _arima_given(spark, sf):
    """On the same complete rows and split as the other forecasters."""
    h, _ = FC.complete_rows(V.hourly(spark, sf))
    params = h.select("series").distinct().select(
        "series", F.lit(ARIMA_PHI).alias("phi"), F.lit(ARIMA_THETA).alias("theta"))
    return AR.arima_forecast(h, "series", "ts", "demand", params)


@query("arima_forecast_given_params", V.with_views(
    f"SELECT series, {G.ts_text('ts')} AS ts, h, actual, round(forecast, 6) AS forecast FROM af",
    "h", ctes=PRED_CTES + ARIMA_CTES))
def q_arima_forecast_given_params(spark, sf):
    out = _arima_given(spark, sf)
    return out.select("series", ts_text("ts").alias("ts"), "h", "actual", r6("forecast").alias("forecast"))


# --- comparison, top-k, best (U1, O2-O4) ---------------------------------------

COMPARISON_CTES = PRED_CTES + ARIMA_CTES + [
    ("cmp", """SELECT series, model, mae, rmse, r2, mape FROM mu
        UNION ALL
        SELECT series, 'arima' AS model, avg(abs(forecast - actual)) AS mae,
               sqrt(avg((forecast - actual) * (forecast - actual))) AS rmse, NULL AS r2,
               avg(abs(forecast - actual) / nullif(abs(actual), 0)) * 100 AS mape
        FROM af GROUP BY series"""),
]


def _comparison(spark, sf):
    m = _metrics(spark, sf).select("series", "model", "mae", "rmse", "r2", "mape")
    a = _arima_given(spark, sf)
    e = F.col("forecast") - F.col("actual")
    arima = a.groupBy("series").agg(
        F.lit("arima").alias("model"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.nullif(F.abs(F.col("actual")), F.lit(0.0))) * 100).alias("mape"))
    return M.model_comparison([m, arima])


@query("model_comparison", V.with_views(
    """SELECT series, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2,
              round(mape, 6) AS mape, row_number() OVER (PARTITION BY series ORDER BY mae, model) AS rank
       FROM cmp""", "h", ctes=COMPARISON_CTES))
def q_model_comparison(spark, sf):
    out = M.rank_models(_comparison(spark, sf), ["series"])
    return rounded(out, ["mae", "rmse", "r2", "mape"])


@query("top_models", V.with_views(
    """SELECT series, model, round(mae, 6) AS mae, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY series ORDER BY mae, model) AS rank
         FROM cmp WHERE model <> 'naive') WHERE rank <= 3""", "h", ctes=COMPARISON_CTES))
def q_top_models(spark, sf):
    out = M.top_models(_comparison(spark, sf), k=3, keys=["series"])
    return rounded(out.select("series", "model", "mae", "rank"), ["mae"])


@query("best_model", V.with_views(
    """SELECT series, arg_min(model, (mae, model)) AS best_model, round(min(mae), 6) AS best_mae
       FROM cmp WHERE mae IS NOT NULL GROUP BY series""", "h", ctes=COMPARISON_CTES))
def q_best_model(spark, sf):
    return rounded(M.best_model(_comparison(spark, sf), ["series"]), ["best_mae"])


# --- one-feature linear regression (M1, SQL form) ------------------------------

@query("linear_one_feature", V.with_views(
    f"""SELECT c.series, round(slope, 6) AS slope, round(intercept, 6) AS intercept, n,
               {', '.join(f'round({c}, 6) AS {c}' for c in METRIC_COLS[1:])}
        FROM co c JOIN ({metrics_sql('lp', 'series', 'actual', 'predicted', rnd=False)}) m
        USING (series)""", "h",
    ctes=PRED_CTES + [
        ("co", """SELECT series, regr_slope(demand, l1) AS slope, regr_intercept(demand, l1) AS intercept
                  FROM fs WHERE rn < floor(cnt * 0.8) GROUP BY series"""),
        ("lp", """SELECT fs.series, demand AS actual, intercept + slope * l1 AS predicted
                  FROM fs JOIN co USING (series) WHERE rn >= floor(cnt * 0.8)""")]))
def q_linear_one_feature(spark, sf):
    out = FC.linear_one_feature(V.hourly(spark, sf))
    return rounded(out, ["slope", "intercept", *METRIC_COLS[1:]])
