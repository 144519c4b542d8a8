"""Registered model queries (M1-M10, O6): rows-only checks, since fitted
models have no SQL twin. Unit tests compare linear and ridge fits with
numpy normal equations and the ARIMA fit with a simulated series."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import functions as F

from demandflow.functions.scalars import r6, ts_text
from demandflow.operators import arima as AR
from demandflow.operators import metrics as M
from demandflow.operators import models as MO
from demandflow.operators import select as SE
from demandflow.operators import series as S
from demandflow.plans import views as V
from demandflow.plans.catalog import query

OUT = ["series", "model", "n", "mae", "rmse", "r2", "mape", "mae_improvement",
       "rmse_improvement", "mape_improvement"]


class Request:
    """The rows that all models of a request share: features of every series, complete rows,
    chronological split; ``data`` (scaled, cached) holds the series with enough rows, ``rejected``
    (series, reason) the others."""

    def __init__(self, rows, min_rows: int = 50):
        table = MO.feature_table(rows).persist()
        checked = SE.eligible_series(table, "series", min_rows)
        # series without any complete row are listed too
        self.rejected = (rows.select("series").distinct().join(checked, "series", "left")
                             .where(~F.coalesce("eligible", F.lit(False)))
                             .select("series", F.coalesce("reason", F.lit("no complete rows")).alias("reason")))
        self.table = SE.keep_eligible(table, "series", min_rows)
        self.data = MO.compact(MO.design(self.table, MO.MODEL_FEATURES))
        self.empty = self.data.isEmpty()

    def with_rejected(self, out):
        """The result with a row per rejected series: its reason, no figures."""
        return out.withColumn("reason", F.lit(None).cast("string")).unionByName(self.rejected, allowMissingColumns=True)

    def nothing(self):
        """A result without rows, for requests that reject every series."""
        return self.table.sparkSession.createDataFrame([], "series string, model string, n long, " + ", ".join(
            f"{c} double" for c in OUT[3:]))


def _fit_eval(spark, sf, name):
    r = Request(V.weather(spark, sf))
    out = r.nothing() if r.empty else MO.evaluate(MO.fit_predict(r.data, name)[1], name)
    return r.with_rejected(out.select(*OUT).withColumns({c: r6(c) for c in OUT[3:]}))


@query("fit_linear")
def q_fit_linear(spark, sf):
    return _fit_eval(spark, sf, "linear")


@query("fit_ridge")
def q_fit_ridge(spark, sf):
    return _fit_eval(spark, sf, "ridge")


@query("fit_random_forest")
def q_fit_random_forest(spark, sf):
    return _fit_eval(spark, sf, "random_forest")


@query("fit_gbt")
def q_fit_gbt(spark, sf):
    return _fit_eval(spark, sf, "xgboost")


@query("feature_importance")
def q_feature_importance(spark, sf):
    r = Request(V.weather(spark, sf))
    feats = [f for f in MO.MODEL_FEATURES if f in r.data.columns]
    rows = [] if r.empty else MO.feature_importance(MO.fit_predict(r.data, "random_forest")[0], feats)
    return spark.createDataFrame(rows, "feature string, importance double")


@query("fit_stacking")
def q_fit_stacking(spark, sf):
    r = Request(V.weather(spark, sf))
    out = r.nothing() if r.empty else MO.evaluate(MO.stacking(r.data, ["linear", "ridge", "random_forest"]), "stacking")
    return r.with_rejected(out.select(*OUT).withColumns({c: r6(c) for c in OUT[3:]}))


#: Out-of-fold predictions of the line through lag 1, pooled over the train rows of all series.
OOF_SQL = """SELECT series, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, t.fold, round(intercept + slope * x, 4) AS predicted FROM (
  SELECT series, ts, demand, x, CASE WHEN rn < (n % 5) * (n // 5 + 1) THEN rn // (n // 5 + 1)
         ELSE (rn - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) + n % 5 END AS fold FROM tr) t
JOIN fit ON fit.fold = t.fold"""
OOF_CTES = [
    ("lg", "SELECT series, ts, demand, lag(demand, 1) OVER (PARTITION BY series ORDER BY ts) AS x FROM h"),
    ("cp", """SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS rn0, count(*) OVER (PARTITION BY series) AS n0
              FROM lg WHERE x IS NOT NULL"""),
    ("tr", "SELECT series, ts, demand, x, rn0 AS rn, floor(n0 * 0.8)::BIGINT AS n FROM cp WHERE rn0 < floor(n0 * 0.8)"),
    ("tf", """SELECT series, demand, x, CASE WHEN rn < (n % 5) * (n // 5 + 1) THEN rn // (n // 5 + 1)
              ELSE (rn - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) + n % 5 END AS fold FROM tr"""),
    ("fit", """SELECT f.fold, regr_slope(demand, x) AS slope, regr_intercept(demand, x) AS intercept
               FROM tf JOIN (SELECT DISTINCT fold FROM tf) f ON tf.fold <> f.fold GROUP BY f.fold"""),
]


@query("stacking_out_of_fold", V.with_views(OOF_SQL, "h", ctes=OOF_CTES))
def q_stacking_out_of_fold(spark, sf):
    """The linear out-of-fold step of stacking (M6): each fold predicted from the sums of the others."""
    rows = S.with_series_windows(V.hourly(spark, sf), "series", "ts", 1, lambda w: {"x": F.lag("demand", 1).over(w)})
    split = S.chrono_split(rows.where("x IS NOT NULL"), ["series"], "ts")
    train = S.stacking_folds(split.where("split = 'train'"), ["series"], "ts", 5)
    out = MO.out_of_fold(train, ["x"], "demand")
    return out.select("series", ts_text("ts").alias("ts"), "fold", F.round("predicted", 4).alias("predicted"))


def _arima_eval(table):
    """Per-series ARIMA(1,1,1) on the rows and the split of the other models:
    fitted on all train rows, scored on all test rows next to the
    seasonal-naive forecast of the same rows."""
    rows = table.select("series", "ts", "demand", "demand_lag24")
    params = AR.fit_arima(rows, "series", "ts", "demand")
    test = AR.arima_forecast(rows, "series", "ts", "demand", params, carry=["demand_lag24"])
    m = M.regression_metrics(test, ["series"], "actual", "forecast").withColumn("model", F.lit("arima"))
    b = M.regression_metrics(test, ["series"], "actual", "demand_lag24")
    return M.improvement_over_baseline(m, b, ["series"]).join(params, "series")


@query("fit_arima")
def q_fit_arima(spark, sf):
    r = Request(V.weather(spark, sf))
    out = _arima_eval(r.table)
    return r.with_rejected(out.select(*OUT, "phi", "theta").withColumns({c: r6(c) for c in OUT[3:]}))


PHIS = THETAS = [-0.6, -0.2, 0.0, 0.3, 0.7]


@query("arima_css", """WITH RECURSIVE """ + V.with_views("""SELECT series, phi, theta, round(sum(e * e) / max(n), 2) AS css FROM run
GROUP BY series, phi, theta""", "h", ctes=[
    ("dd", """SELECT series, ts, row_number() OVER s - 1 AS rn, demand - lag(demand, 1) OVER s AS d,
              coalesce(lag(demand, 1) OVER s - lag(demand, 2) OVER s, 0) AS p, floor(count(*) OVER (PARTITION BY series) * 0.8) AS n
              FROM h WINDOW s AS (PARTITION BY series ORDER BY ts)"""),
    ("pairs", f"SELECT unnest({PHIS}::DOUBLE[]) AS phi, th.theta FROM (SELECT unnest({THETAS}::DOUBLE[]) AS theta) th"),
    ("run(series, phi, theta, rn, n, e)", """SELECT series, phi, theta, rn, n, d - phi * p FROM dd, pairs WHERE rn = 1 AND rn < n
              UNION ALL SELECT r.series, r.phi, r.theta, dd.rn, r.n, dd.d - r.phi * dd.p - r.theta * r.e
              FROM run r JOIN dd ON dd.series = r.series AND dd.rn = r.rn + 1 WHERE dd.rn < r.n"""),
]).removeprefix("WITH "))
def q_arima_css(spark, sf):
    """The sum of squares that the ARIMA fit minimises (M7), on a coarse grid, per train row."""
    h = V.hourly(spark, sf)
    n = h.groupBy("series").agg(F.floor(F.count(F.lit(1)) * 0.8).alias("n"))
    css = AR.css_grid(h, "series", "ts", "demand", PHIS, THETAS, chunk_rows=100)
    return css.join(n, "series").select("series", "phi", "theta", F.round(F.col("css") / F.col("n"), 2).alias("css"))


@query("arima_forecast")
def q_arima_forecast(spark, sf):
    r = Request(V.weather(spark, sf))
    rows = r.table.select("series", "ts", "demand")
    params = AR.fit_arima(rows, "series", "ts", "demand")
    fc = AR.arima_forecast(rows, "series", "ts", "demand", params)
    return r.with_rejected(fc.select("series", ts_text("ts").alias("ts"), "h", "actual", r6("forecast").alias("forecast")))


def forecast_report(rows, models=("linear", "random_forest", "xgboost", "arima"), stack: int = 0):
    """The forecast request of the web app for every series of ``rows`` (series, ts, demand,
    weather) and several models at once (M8, E5): a seasonal-naive baseline row, every fitted
    model on the same test rows, with ``stack`` also the stacking of that many best models by
    mean MAE (their fits are reused), then improvement, normalised metrics, score, grade, rank
    and the best model per series. Series without enough rows come with the reason."""
    for name in models:
        if name != "arima":
            MO.make_estimator(name)               # unknown names fail before any job
    r = Request(rows)
    if r.empty:
        blank = r.nothing().withColumn("rank", F.lit(None).cast("int"))
        return r.with_rejected(M.performance_score(M.normalized_metrics(blank.withColumn("mean_actual", F.lit(None).cast("double"))))
                               .withColumn("is_best", F.col("rank") == 1))
    test = r.data.where(F.col("split") == "test")
    base = M.regression_metrics(test, ["series"], "demand", "demand_lag24")
    frames, fitted = [M.improvement_over_baseline(base.withColumn("model", F.lit("naive")), base, ["series"])], {}
    named = [m for m in models if m != "arima"]
    with ThreadPoolExecutor(max_workers=4) as pool:           # independent fits, concurrent jobs
        done = dict(zip(named, pool.map(lambda m: MO.fit_predict(r.data, m), named)))
    for name in models:
        if name == "arima":
            frames.append(_arima_eval(r.table).drop("phi", "theta", "sigma2", "n_train"))
        else:
            fitted[name], pred = done[name]
            frames.append(MO.evaluate(pred, name))
    if stack:
        scored = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames[1:])
        order = scored.where(F.col("model") != "arima").groupBy("model").agg(F.avg("mae").alias("m")).orderBy("m", "model")
        best = [x.model for x in order.limit(stack).collect()]        # names of models
        frames.append(MO.evaluate(MO.stacking(r.data, best, fitted=fitted), "stacking"))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    out = M.performance_score(M.normalized_metrics(M.rank_models(out, ["series"])))
    return r.with_rejected(out.withColumn("is_best", F.col("rank") == 1))


@query("forecast_report")
def q_forecast_report(spark, sf):
    out = forecast_report(V.weather(spark, sf))
    cols = ["mae", "rmse", "r2", "mape", "mae_improvement", "mae_norm", "rmse_norm", "r2_norm", "mape_norm",
            "performance_score"]
    return out.select("series", "model", "n", "rank", "is_best", "reason", *cols, "performance_grade").withColumns(
        {c: r6(c) for c in cols})


@query("stack_best_models")
def q_stack_best_models(spark, sf):
    """Stacking on the three best fitted models by MAE, ranked with them; ``is_best`` marks the
    best model of each series."""
    out = forecast_report(V.weather(spark, sf), ("linear", "ridge", "random_forest", "xgboost"), stack=3)
    return out.select("series", "model", "rank", "is_best", "reason", *[r6(c).alias(c) for c in ("mae", "rmse", "mae_improvement")])


@query("sample_rows")
def q_sample_rows(spark, sf):
    """100 rows drawn without replacement by a seeded random order."""
    return SE.sample_rows(V.weather(spark, sf), 100).select("series", ts_text("ts").alias("ts"), "demand")
