"""Registered profiling queries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from demandflow.functions.scalars import r6, ts_text
from demandflow.operators import profile as P
from demandflow.operators import select as S
from demandflow.plans import sqlgen as G
from demandflow.plans import views as V
from demandflow.plans.catalog import query

D_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
          ("event_type", "string"), ("value", "double"), ("ozone", "double"),
          ("region", "string"), ("time_s", "bigint"), ("time_str", "string")]


def _rounded(df, cols):
    return df.withColumns({c: r6(c) for c in cols})


# --- R2 / R4 / R5 ------------------------------------------------------------

@query("column_info", V.with_views(
    "SELECT * FROM (" + G.union_all([
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, "
        f"count(*) - count({c}) AS null_count, count(*) AS n_rows FROM d"
        for i, (c, t) in enumerate(D_COLS)]) + ")", "d"))
def q_column_info(spark, sf):
    return P.column_info(V.dirty(spark, sf))


@query("null_counts", V.with_views(G.union_all([
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count FROM d"
    for c, _ in D_COLS]), "d"))
def q_null_counts(spark, sf):
    return P.null_counts(V.dirty(spark, sf))


@query("duplicate_count", V.with_views(
    """SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS n_distinct,
              count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS n_duplicates
       FROM d""", "d"))
def q_duplicate_count(spark, sf):
    return P.duplicate_count(V.dirty(spark, sf))


# --- R3 / R6 -----------------------------------------------------------------

@query("describe", V.with_views(G.describe_sql("w", G.W_MEASURES), "w"))
def q_describe(spark, sf):
    out = P.describe(V.weather(spark, sf), G.W_MEASURES)
    return _rounded(out, ["mean", "std", "min", "p25", "p50", "p75", "max"])


@query("describe_by_series", V.with_views(G.describe_sql("w", G.W_MEASURES, ["series"]), "w"))
def q_describe_by_series(spark, sf):
    out = P.describe(V.weather(spark, sf), G.W_MEASURES, keys=["series"])
    return _rounded(out, ["mean", "std", "min", "p25", "p50", "p75", "max"])


@query("correlation_matrix", V.with_views(G.union_all([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM w"
    for a, b in product(G.W_MEASURES, G.W_MEASURES)]), "w"))
def q_correlation_matrix(spark, sf):
    return _rounded(P.correlation_matrix(V.weather(spark, sf), G.W_MEASURES), ["corr"])


# --- R1, A1, A6 --------------------------------------------------------------

@query("head_rows", V.with_views(
    f"SELECT series, {G.ts_text('ts')} AS ts, demand FROM h ORDER BY ts, series LIMIT 10", "h"))
def q_head_rows(spark, sf):
    h = V.hourly(spark, sf)
    return P.head(h, ["ts", "series"], 10).select("series", ts_text("ts").alias("ts"), "demand")


@query("scalar_summary", V.with_views(
    """SELECT count(*) AS n, round(avg(demand), 6) AS mean, min(demand) AS min, max(demand) AS max,
              round(sum(demand), 2) AS total, round(stddev_samp(demand), 6) AS std,
              arg_max(series, demand) AS series_of_max
       FROM h""", "h"))
def q_scalar_summary(spark, sf):
    h = V.hourly(spark, sf)
    return h.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("demand")).alias("mean"),
                 F.min("demand").alias("min"), F.max("demand").alias("max"),
                 F.round(F.sum("demand"), 2).alias("total"),
                 r6(F.stddev_samp("demand")).alias("std"),
                 F.max_by("series", "demand").alias("series_of_max"))


@query("distinct_counts", V.with_views(
    """SELECT count(DISTINCT event_type) AS n_series, count(DISTINCT user_id) AS n_users,
              count(DISTINCT region) AS n_regions FROM d""", "d"))
def q_distinct_counts(spark, sf):
    d = V.dirty(spark, sf)
    return d.agg(F.countDistinct("event_type").alias("n_series"),
                 F.countDistinct("user_id").alias("n_users"),
                 F.countDistinct("region").alias("n_regions"))


# --- S8, P3, P4 --------------------------------------------------------------

@query("list_series", V.with_views(
    """SELECT 'All' AS series, true AS is_default
       UNION ALL SELECT DISTINCT series, false FROM h WHERE series IS NOT NULL""", "h"))
def q_list_series(spark, sf):
    return S.list_series(V.hourly(spark, sf), "series", default="All")


@query("filter_series_time", V.with_views(
    f"""SELECT series, {G.ts_text('ts')} AS ts, demand FROM h
        WHERE lower(series) = lower('CLICK')
          AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",
    "h"))
def q_filter_series_time(spark, sf):
    start, end = "2024-01-03 00:00:00", "2024-01-20 00:00:00"
    out = S.filter_series(V.hourly(spark, sf, start, end), "series", "CLICK")
    out = S.filter_time(out, "ts", start, end)
    return out.select("series", ts_text("ts").alias("ts"), "demand")
