"""The forecast and segmentation requests (M8, P7, S2-S4, E3-E6, C3, C5, C9, C10): their
relational part, from the filters to score and grade, is checked by SQL with the seasonal-naive
model; fitted models and centres by unit tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.scalars import r6, ts_text
from demandflow.operators import requests as RQ
from demandflow.plans import views as V
from demandflow.plans.catalog import query
from demandflow.plans.q_forecast import GRADE_SQL, NORM_SQL, SCORE_SQL, metrics_sql

START, END, LOOKBACK = "2024-01-02 06:00:00", "2024-01-27 18:00:00", 6

CTES = [
    ("g", f"SELECT * FROM h WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"),
    ("l", f"""SELECT series, ts, demand, lag(demand, {LOOKBACK}) OVER s AS naive, lag(demand, {7 * LOOKBACK}) OVER s AS far
              FROM g WINDOW s AS (PARTITION BY series ORDER BY ts)"""),
    ("c", """SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY series) AS cnt
             FROM l WHERE far IS NOT NULL"""),
    ("t", "SELECT series, 'Naive' AS model, ts, demand, naive FROM c WHERE cnt >= 50 AND rn >= floor(cnt * 0.8)"),
    ("mu", metrics_sql("t", "series, model", "demand", "naive", rnd=False)),
    ("nm", NORM_SQL), ("sc", SCORE_SQL),
    ("rj", """SELECT g.series, CASE WHEN coalesce(max(cnt), 0) = 0 THEN 'no complete rows' ELSE 'fewer than 50 complete rows' END AS reason
              FROM (SELECT DISTINCT series FROM g) g LEFT JOIN c USING (series) GROUP BY g.series HAVING coalesce(max(cnt), 0) < 50"""),
]
FIGURES = ["mae", "rmse", "r2", "mape", "mae_norm", "rmse_norm", "r2_norm", "mape_norm", "performance_score"]


def _request(spark, sf, models):
    return RQ.Forecast(V.weather(spark, sf), models, start=START, end=END, lookback=LOOKBACK)


def _figures(request):
    return request.metrics().select("series", "model", "n", *[r6(c).alias(c) for c in FIGURES], "performance_grade", "reason")


@query("forecast_request_naive", V.with_views(f"""SELECT series, model, n, {", ".join(f"round({c}, 6) AS {c}" for c in FIGURES)},
{GRADE_SQL} AS performance_grade, NULL AS reason FROM sc
UNION ALL SELECT series, NULL, NULL, {", ".join(["NULL"] * len(FIGURES))}, NULL, reason FROM rj""", "h", ctes=CTES))
def q_forecast_request_naive(spark, sf):
    return _figures(_request(spark, sf, ["Naive"]))


@query("forecast_request_points", V.with_views("""SELECT series, model, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date,
demand AS actual, naive AS predicted FROM t""", "h", ctes=CTES))
def q_forecast_request_points(spark, sf):
    return _request(spark, sf, ["Naive"]).points()


@query("forecast_request")
def q_forecast_request(spark, sf):
    """A linear model and ARIMA next to the seasonal-naive one."""
    return _figures(_request(spark, sf, ["Naive", "Linear", "ARIMA"]))


@query("cluster_request")
def q_cluster_request(spark, sf):
    """Centres in original units for the k of the best silhouette, with the scores of that k."""
    out = RQ.Segments(V.weather(spark, sf), k=None, n_init=3)
    best = out.scores.where("best").first()                      # one row; none for an empty table
    figures = {"silhouette": best.silhouette if best else None, "inertia": best.inertia if best else None}
    return out.centres.select(F.lit(out.k).alias("k"), "cluster", *[r6(c).alias(c) for c in out.features],
                              *[F.round(F.lit(v).cast("double"), 6).alias(c) for c, v in figures.items()])


@query("cluster_request_points")
def q_cluster_request_points(spark, sf):
    out = RQ.Segments(V.weather(spark, sf), k=3, keep=["series", "ts"]).points()
    return out.withColumn("ts", ts_text("ts"))


@query("k_score_lines")
def q_k_score_lines(spark, sf):
    """The score report."""
    return RQ.Segments(V.weather(spark, sf), k=None, n_init=3).score_lines()
