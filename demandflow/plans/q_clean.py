"""Registered cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.scalars import r6, ts_text
from demandflow.operators import clean as C
from demandflow.plans import sqlgen as G
from demandflow.plans import views as V
from demandflow.plans.catalog import query

D_OUT = ["event_id", "ts", "user_id", "event_type", "value", "ozone", "region", "time_s", "time_str"]


def _d_rows(df):
    return df.select(*[ts_text(c).alias(c) if c == "ts" else
                       (r6(c).alias(c) if c in ("value", "ozone") else F.col(c))
                       for c in D_OUT if c in df.columns])


def _d_sql(src: str, override: dict[str, str] | None = None, drop=()) -> str:
    override = override or {}
    parts = []
    for c in D_OUT:
        if c in drop:
            continue
        if c in override:
            parts.append(f"{override[c]} AS {c}")
        elif c == "ts":
            parts.append(f"{G.ts_text('ts')} AS ts")
        elif c in ("value", "ozone"):
            parts.append(f"round({c}, 6) AS {c}")
        else:
            parts.append(c)
    return f"SELECT {', '.join(parts)} FROM {src}"


@query("impute_mean", V.with_views(_d_sql("d", {
    "ozone": "round(coalesce(ozone, (SELECT avg(ozone) FROM d)), 6)"}), "d"))
def q_impute_mean(spark, sf):
    return _d_rows(C.impute_mean(V.dirty(spark, sf), ["ozone"]))


@query("impute_mode", V.with_views(_d_sql("d", {
    "region": """coalesce(region, (SELECT region FROM d WHERE region IS NOT NULL
                 GROUP BY region ORDER BY count(*) DESC, region LIMIT 1))"""}), "d"))
def q_impute_mode(spark, sf):
    return _d_rows(C.impute_mode(V.dirty(spark, sf), ["region"]))


@query("column_modes", V.with_views(G.union_all([
    f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS mode FROM d
        WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"""
    for c in ("region", "event_type", "user_id")]), "d"))
def q_column_modes(spark, sf):
    return C.column_modes(V.dirty(spark, sf), ["region", "event_type", "user_id"])


@query("drop_nulls", V.with_views(
    _d_sql("d") + " WHERE ozone IS NOT NULL AND region IS NOT NULL", "d"))
def q_drop_nulls(spark, sf):
    return _d_rows(C.drop_null_rows(V.dirty(spark, sf)))


@query("drop_duplicates", V.with_views(_d_sql("(SELECT DISTINCT * FROM d)"), "d"))
def q_drop_duplicates(spark, sf):
    return _d_rows(C.drop_duplicate_rows(V.dirty(spark, sf)))


@query("drop_columns", V.with_views(_d_sql("d", drop=("ozone", "region", "time_str")), "d"))
def q_drop_columns(spark, sf):
    return _d_rows(C.drop_columns(V.dirty(spark, sf), ["ozone", "region", "time_str", "absent"]))


@query("column_fallback", V.with_views(
    f"SELECT series, {G.ts_text('ts')} AS ts, temperature, temperature AS apparentTemperature FROM w",
    "w"))
def q_column_fallback(spark, sf):
    w = V.weather(spark, sf).select("series", "ts", F.col("temperature").alias("apparentTemperature"))
    out = C.resolve_columns(w)
    return out.select("series", ts_text("ts").alias("ts"), "temperature", "apparentTemperature")


# --- outliers ------------------------------------------------------------------

def _bounds_sql(cols, src="w"):
    return G.union_all([
        f"""SELECT '{c}' AS "column", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3
            FROM {src} WHERE {c} IS NOT NULL""" for c in cols])


IQR_SQL = f"""SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper,
       n_outliers, round(n_outliers * 100.0 / n_rows, 6) AS pct_outliers
FROM b JOIN ({G.union_all([
    f'''SELECT '{c}' AS "column", count(*) AS n_rows,
        count(*) FILTER (WHERE {c} < (SELECT q1 - 1.5 * (q3 - q1) FROM b WHERE "column" = '{c}')
                            OR {c} > (SELECT q3 + 1.5 * (q3 - q1) FROM b WHERE "column" = '{c}'))
        AS n_outliers FROM w''' for c in G.W_MEASURES])}) n USING ("column")"""


@query("iqr_outliers", V.with_views(IQR_SQL, "w", ctes=[("b", _bounds_sql(G.W_MEASURES))]))
def q_iqr_outliers(spark, sf):
    out = C.iqr_outliers(V.weather(spark, sf), G.W_MEASURES)
    return out.withColumns({c: r6(c) for c in ("q1", "q3", "iqr", "lower", "upper",
                                               "pct_outliers")})


CAP_COLS = ["demand", "temperature", "precipIntensity", "windSpeed"]

CAP_SQL = f"""SELECT series, {G.ts_text('ts')} AS ts, """ + ", ".join(
    f"""round(least(greatest({c}, (SELECT q1 - 1.5 * (q3 - q1) FROM b WHERE "column" = '{c}')),
                   (SELECT q3 + 1.5 * (q3 - q1) FROM b WHERE "column" = '{c}')), 6) AS {c}"""
    for c in CAP_COLS) + " FROM w"


@query("cap_outliers", V.with_views(CAP_SQL, "w", ctes=[("b", _bounds_sql(CAP_COLS))]))
def q_cap_outliers(spark, sf):
    w = V.weather(spark, sf).select("series", "ts", *CAP_COLS)
    out = C.cap_outliers(w, CAP_COLS)
    return out.select("series", ts_text("ts").alias("ts"), *[r6(c).alias(c) for c in CAP_COLS])


def _stats4(src, cols, suffix=""):
    return G.union_all([
        f"""SELECT '{c}' AS "column", round(min({c})::DOUBLE, 6) AS min{suffix},
            round(max({c})::DOUBLE, 6) AS max{suffix}, round(avg({c}), 6) AS mean{suffix},
            round(stddev_samp({c}), 6) AS std{suffix} FROM {src}""" for c in cols])


CAPPED_SQL = "SELECT series, ts, " + ", ".join(
    f"""least(greatest({c}, (SELECT q1 - 1.5 * (q3 - q1) FROM b WHERE "column" = '{c}')),
              (SELECT q3 + 1.5 * (q3 - q1) FROM b WHERE "column" = '{c}')) AS {c}"""
    for c in CAP_COLS) + " FROM w"


@query("capping_report", V.with_views(
    f"""SELECT * FROM ({_stats4('w', CAP_COLS)}) x
        JOIN ({_stats4('cw', CAP_COLS, '_capped')}) y USING ("column")""", "w",
    ctes=[("b", _bounds_sql(CAP_COLS)), ("cw", CAPPED_SQL)]))
def q_capping_report(spark, sf):
    out = C.capping_report(V.weather(spark, sf), CAP_COLS)
    return out.withColumns({c: r6(c) for c in out.columns if c != "column"})


# --- time parsing ------------------------------------------------------------------

@query("parse_time", V.with_views(
    f"""SELECT event_id, {G.ts_text('make_timestamp(time_s * 1000000)')} AS time_from_seconds,
               {G.ts_text("try_strptime(time_str, '%Y-%m-%d %H:%M:%S')")} AS time_from_text
        FROM d_base""", "d"))
def q_parse_time(spark, sf):
    base = V.dirty_base(spark, sf)
    out = C.parse_time(base, "time_s", "time_from_seconds", unit="s")
    out = C.parse_time(out, "time_str", "time_from_text", fmt="yyyy-MM-dd HH:mm:ss")
    return out.select("event_id", ts_text("time_from_seconds").alias("time_from_seconds"),
                      ts_text("time_from_text").alias("time_from_text"))


@query("parse_failures", V.with_views(
    """SELECT count(*) AS n_rows,
              count(*) FILTER (WHERE try_strptime(time_str, '%Y-%m-%d %H:%M:%S') IS NULL) AS n_failed
       FROM d""", "d"))
def q_parse_failures(spark, sf):
    out = C.parse_time(V.dirty(spark, sf), "time_str", "t", fmt="yyyy-MM-dd HH:mm:ss")
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("t").isNull()).alias("n_failed"))
