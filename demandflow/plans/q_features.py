"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.scalars import r6, ts_text
from demandflow.operators import features as FE
from demandflow.operators import select as SE
from demandflow.operators import series as S
from demandflow.plans import sqlgen as G
from demandflow.plans import views as V
from demandflow.plans.catalog import query

TS = G.ts_text("ts")

SEASON_SQL = """CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) IN (3, 4, 5) THEN 'Spring'
     WHEN month(ts) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""
TOD_SQL = """CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 12 THEN 'Morning'
     WHEN hour(ts) < 18 THEN 'Afternoon' ELSE 'Evening' END"""
DOW_SQL = "(isodow(ts) - 1)"


def _out(df, cols, rnd=()):
    return df.select("series", ts_text("ts").alias("ts"),
                     *[r6(c).alias(c) if c in rnd else F.col(c) for c in cols])


# --- calendar, season, weather, cyclical, names ---------------------------------

@query("calendar_features", V.with_views(
    f"""SELECT series, {TS} AS ts, hour(ts) AS hour, day(ts) AS day, month(ts) AS month,
               {DOW_SQL} AS day_of_week, CASE WHEN {DOW_SQL} >= 5 THEN 1 ELSE 0 END AS is_weekend
        FROM w""", "w"))
def q_calendar_features(spark, sf):
    out = FE.calendar_features(V.weather(spark, sf).select("series", "ts"), "ts")
    return _out(out, ["hour", "day", "month", "day_of_week", "is_weekend"])


@query("season_time_of_day", V.with_views(
    f"""SELECT series, {TS} AS ts, month(ts) AS month, hour(ts) AS hour,
               {SEASON_SQL} AS season, {TOD_SQL} AS time_of_day
        FROM (SELECT series, ts FROM o UNION ALL SELECT series, ts FROM h)""", "o", "h"))
def q_season_time_of_day(spark, sf):
    rows = (V.daily_orders(spark, sf).select("series", "ts")
            .unionByName(V.hourly(spark, sf).select("series", "ts")))
    out = FE.season_time_of_day(FE.calendar_features(rows, "ts"))
    return _out(out, ["month", "hour", "season", "time_of_day"])


@query("weather_features", V.with_views(
    f"""SELECT series, {TS} AS ts,
           CASE WHEN humidity < 0.4 THEN temperature ELSE temperature + 0.5 * (humidity * 10) END
             AS heat_index,
           CASE WHEN precipProbability > 0.5 THEN 1 ELSE 0 END AS is_rainy,
           CASE WHEN cloudCover > 0.5 THEN 1 ELSE 0 END AS is_cloudy,
           temperature * humidity AS temp_humidity_interaction
        FROM w""", "w"))
def q_weather_features(spark, sf):
    out = FE.weather_features(V.weather(spark, sf))
    # row-wise IEEE arithmetic on the same inputs: equal in both engines
    # without rounding (rounding would only add half-way ties)
    return _out(out, ["heat_index", "is_rainy", "is_cloudy", "temp_humidity_interaction"])


CYC = [("hour", "hour(ts)", 24), ("day_of_week", DOW_SQL, 7), ("month", "month(ts)", 12)]


@query("cyclical_features", V.with_views(
    f"SELECT series, {TS} AS ts, " + ", ".join(
        f"round(sin(2 * pi() * {e} / {p}), 6) AS {c}_sin, round(cos(2 * pi() * {e} / {p}), 6) AS {c}_cos"
        for c, e, p in CYC) + " FROM w", "w"))
def q_cyclical_features(spark, sf):
    out = FE.cyclical_features(FE.calendar_features(V.weather(spark, sf).select("series", "ts")))
    cols = [f"{c}_{f}" for c, _, _ in CYC for f in ("sin", "cos")]
    return _out(out, cols, rnd=cols)


@query("day_name", V.with_views(
    f"""SELECT series, {TS} AS ts, {DOW_SQL} AS day_of_week, dayname(ts) AS day_name FROM w""", "w"))
def q_day_name(spark, sf):
    out = FE.day_names(FE.calendar_features(V.weather(spark, sf).select("series", "ts")))
    return _out(out, ["day_of_week", "day_name"])


# --- windows -------------------------------------------------------------------

LAGS = (1, 24, 168)


@query("lag_features", V.with_views(
    f"SELECT series, {TS} AS ts, demand, " + ", ".join(
        f"lag(demand, {n}) OVER w AS demand_lag{n}" for n in LAGS)
    + " FROM h WINDOW w AS (PARTITION BY series ORDER BY ts)", "h"))
def q_lag_features(spark, sf):
    out = S.lag_features(V.hourly(spark, sf), "series", "ts", "demand", lags=LAGS)
    return _out(out, ["demand", *[f"demand_lag{n}" for n in LAGS]])


ROLL = (6, 12, 24)


@query("rolling_features", V.with_views(
    f"SELECT series, {TS} AS ts, demand, " + ", ".join(
        f"round(avg(demand) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS demand_roll{n}_mean, "
        f"round(coalesce(stddev_samp(demand) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0), 6)"
        f" AS demand_roll{n}_std" for n in ROLL)
    + " FROM h WINDOW w AS (PARTITION BY series ORDER BY ts)", "h"))
def q_rolling_features(spark, sf):
    out = S.rolling_features(V.hourly(spark, sf), "series", "ts", "demand", windows=ROLL)
    cols = [f"demand_roll{n}_{s}" for n in ROLL for s in ("mean", "std")]
    return _out(out, ["demand", *cols], rnd=cols)


@query("diff_from_daily_mean", V.with_views(
    f"""SELECT series, {TS} AS ts, temperature,
           round(temperature - avg(temperature) OVER (PARTITION BY series, CAST(ts AS DATE)) + 1e-9, 4)
             AS temp_diff_from_daily_avg
        FROM w""", "w"))
def q_diff_from_daily_mean(spark, sf):
    out = S.diff_from_daily_mean(V.weather(spark, sf), "series", "ts", "temperature",
                                 name="temp_diff_from_daily_avg")
    # means of a few 6-decimal values often end in an exact half at the
    # rounding digit, where the engines' rounding rules differ: a 1e-9 nudge
    # (far above float noise, far below the shown digits) settles ties alike
    out = out.withColumn("temp_diff_from_daily_avg",
                         F.round(F.col("temp_diff_from_daily_avg") + 1e-9, 4))
    return _out(out, ["temperature", "temp_diff_from_daily_avg"])


TIME_ORDER_SQL = f"""SELECT series, count(*) AS n_rows, {G.ts_text('min(ts)')} AS first_ts,
       {G.ts_text('max(ts)')} AS last_ts,
       count(*) FILTER (WHERE delta = 0) AS n_repeated_ts,
       count(*) FILTER (WHERE delta > {{step}}) AS n_gaps,
       CAST(coalesce(max(delta), 0) AS BIGINT) AS max_step_seconds
FROM (SELECT series, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts))) / 1e6
             AS delta FROM {{src}}) GROUP BY series"""


def _time_order(df, step):
    out = S.time_order_report(df, "series", "ts", step_seconds=step)
    return out.withColumns({"first_ts": ts_text("first_ts"), "last_ts": ts_text("last_ts")})


@query("time_order_report", V.with_views(TIME_ORDER_SQL.format(step=3600, src="h"), "h"))
def q_time_order_report(spark, sf):
    return _time_order(V.hourly(spark, sf), 3600)


@query("time_order_report_daily", V.with_views(TIME_ORDER_SQL.format(step=86400, src="o"), "o"))
def q_time_order_report_daily(spark, sf):
    return _time_order(V.daily_orders(spark, sf), 86400)


# --- guards, splits, scaling -------------------------------------------------------

@query("eligible_series", V.with_views(
    """SELECT series, count(*) AS n_rows, count(*) FILTER (WHERE l1 IS NOT NULL AND l168 IS NOT NULL)
              AS n_complete,
              CASE WHEN count(*) FILTER (WHERE l1 IS NOT NULL AND l168 IS NOT NULL) = 0 THEN 'no complete rows'
                   WHEN count(*) FILTER (WHERE l1 IS NOT NULL AND l168 IS NOT NULL) < 500
                   THEN 'fewer than 500 complete rows' END AS reason,
              count(*) FILTER (WHERE l1 IS NOT NULL AND l168 IS NOT NULL) >= 500 AS eligible
       FROM (SELECT series, lag(demand, 1) OVER w AS l1, lag(demand, 168) OVER w AS l168
             FROM h WINDOW w AS (PARTITION BY series ORDER BY ts)) GROUP BY series""", "h"))
def q_eligible_series(spark, sf):
    f = S.lag_features(V.hourly(spark, sf), "series", "ts", "demand", lags=(1, 168))
    return SE.eligible_series(f, "series", min_rows=500, required=["demand_lag1", "demand_lag168"])


@query("chrono_split", V.with_views(
    f"""SELECT series, {TS} AS ts, CASE WHEN rn < floor(cnt * 0.8) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS rn,
                     count(*) OVER (PARTITION BY series) AS cnt FROM h)""", "h"))
def q_chrono_split(spark, sf):
    return _out(S.chrono_split(V.hourly(spark, sf), "series", "ts"), ["split"])


@query("tail_rows", V.with_views(
    f"""SELECT series, {TS} AS ts, demand FROM (SELECT *, row_number() OVER (PARTITION BY series
           ORDER BY ts DESC) AS k FROM h) WHERE k <= 100""", "h"))
def q_tail_rows(spark, sf):
    return _out(S.tail_rows(V.hourly(spark, sf), "series", "ts", 100), ["demand"])


@query("head_rows_per_series", V.with_views(
    f"""SELECT series, {TS} AS ts, demand FROM (SELECT *, row_number() OVER (PARTITION BY series
           ORDER BY ts) AS k FROM h) WHERE k <= 100""", "h"))
def q_head_rows_per_series(spark, sf):
    return _out(S.head_rows(V.hourly(spark, sf), "series", "ts", 100), ["demand"])


@query("standardize", V.with_views(
    f"SELECT series, {TS} AS ts, " + ", ".join(
        f"""round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1
               ELSE stddev_pop({c}) OVER () END, 6) AS {c}""" for c in G.CLUSTER_FEATURES)
    + " FROM w", "w"))
def q_standardize(spark, sf):
    w = V.weather(spark, sf)
    out = FE.standardize(w, G.CLUSTER_FEATURES)
    return _out(out, G.CLUSTER_FEATURES, rnd=G.CLUSTER_FEATURES)


@query("standardize_train_test", V.with_views(
    f"""SELECT series, {TS} AS ts, split, round((demand - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS demand
        FROM sp, (SELECT avg(demand) AS m, stddev_pop(demand) AS s FROM sp WHERE split = 'train')""", "h",
    ctes=[("sp", """SELECT series, ts, demand, CASE WHEN rn < floor(cnt * 0.8) THEN 'train' ELSE 'test' END
                     AS split FROM (SELECT series, ts, demand,
                     row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS rn,
                     count(*) OVER (PARTITION BY series) AS cnt FROM h)""")]))
def q_standardize_train_test(spark, sf):
    sp = S.chrono_split(V.hourly(spark, sf), "series", "ts")
    stats = FE.scaler_stats(sp.where(F.col("split") == "train"), ["demand"])
    return _out(FE.standardize(sp, ["demand"], stats), ["split", "demand"], rnd=("demand",))
