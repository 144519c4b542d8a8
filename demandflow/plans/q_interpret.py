"""Registered cluster-interpretation queries (A2-A4, A7, A8, W7-W9, D1-D3,
F14, S6, S7) on the weather-like view, with the series as the cluster label."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.scalars import r6, ts_text
from demandflow.operators import features as FE
from demandflow.operators import interpret as I
from demandflow.plans import sqlgen as G
from demandflow.plans import views as V
from demandflow.plans.catalog import query

FEATS = G.CLUSTER_FEATURES
TOD_VALUES = ["Afternoon", "Evening", "Morning", "Night"]

WC_SQL = """SELECT *, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
   CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 12 THEN 'Morning'
        WHEN hour(ts) < 18 THEN 'Afternoon' ELSE 'Evening' END AS time_of_day,
   CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) IN (3, 4, 5) THEN 'Spring'
        WHEN month(ts) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season FROM w"""


def _wc(spark, sf):
    return FE.season_time_of_day(FE.calendar_features(V.weather(spark, sf)))


def _q(sql):
    return V.with_views(sql, "w", ctes=[("wc", WC_SQL)])


@query("cluster_means", _q(
    "SELECT series, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in FEATS)
    + " FROM wc GROUP BY series"))
def q_cluster_means(spark, sf):
    out = I.cluster_means(_wc(spark, sf), "series", FEATS)
    return out.withColumns({c: r6(c) for c in FEATS})


@query("cluster_sizes", _q(
    """SELECT series, count(*) AS size, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
       FROM wc GROUP BY series"""))
def q_cluster_sizes(spark, sf):
    return I.cluster_sizes(_wc(spark, sf), "series").withColumn("pct", r6("pct"))


@query("category_distribution", _q(
    "SELECT series, " + ", ".join(
        f"round(count(*) FILTER (WHERE time_of_day = '{v}') / count(*), 6) AS {v}" for v in TOD_VALUES)
    + " FROM wc GROUP BY series"))
def q_category_distribution(spark, sf):
    out = I.category_distribution(_wc(spark, sf), "series", "time_of_day", TOD_VALUES)
    return out.withColumns({v: r6(v) for v in TOD_VALUES})


@query("category_shares", _q(
    """SELECT series, hour AS value, count(*) AS count,
              round(count(*) / sum(count(*)) OVER (PARTITION BY series), 6) AS share
       FROM wc GROUP BY series, hour"""))
def q_category_shares(spark, sf):
    return I.value_shares(_wc(spark, sf), "series", "hour").withColumn("share", r6("share"))


@query("top_n_per_group", _q(
    """SELECT * FROM (SELECT series, hour AS value, count(*) AS count,
              round(count(*) / sum(count(*)) OVER (PARTITION BY series), 6) AS share,
              row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, hour) AS rank
       FROM wc GROUP BY series, hour) WHERE rank <= 3"""))
def q_top_n_per_group(spark, sf):
    return I.top_n_per_group(_wc(spark, sf), "series", "hour", 3).withColumn("share", r6("share"))


@query("cluster_vs_overall", _q(G.union_all([
    f"""SELECT series, '{c}' AS feature, round(avg({c}), 6) AS cluster_mean,
           round(min({c})::DOUBLE, 6) AS cluster_min, round(max({c})::DOUBLE, 6) AS cluster_max,
           round((SELECT avg({c}) FROM wc), 6) AS dataset_mean FROM wc GROUP BY series"""
    for c in FEATS])))
def q_cluster_vs_overall(spark, sf):
    out = I.cluster_vs_overall(_wc(spark, sf), "series", FEATS)
    return out.withColumns({c: r6(c) for c in ("cluster_mean", "cluster_min", "cluster_max",
                                               "dataset_mean")})


@query("cluster_box_stats", _q(
    """SELECT series, round(min(demand), 6) AS min, round(quantile_cont(demand, 0.25), 6) AS q1,
              round(quantile_cont(demand, 0.5), 6) AS median, round(quantile_cont(demand, 0.75), 6) AS q3,
              round(max(demand), 6) AS max FROM wc GROUP BY series"""))
def q_cluster_box_stats(spark, sf):
    out = I.cluster_box_stats(_wc(spark, sf), "series", "demand")
    return out.withColumns({c: r6(c) for c in ("min", "q1", "median", "q3", "max")})


LONG_MEANS = "SELECT series, feature, mean FROM (" + G.union_all([
    f"SELECT series, '{c}' AS feature, avg({c}) AS mean FROM wc GROUP BY series" for c in FEATS]) + ")"


@query("cluster_zscores", V.with_views(
    """SELECT series, feature, round(mean, 6) AS mean,
              round((mean - avg(mean) OVER (PARTITION BY feature))
                    / nullif(stddev_samp(mean) OVER (PARTITION BY feature), 0), 6) AS z FROM lm""",
    "w", ctes=[("wc", WC_SQL), ("lm", LONG_MEANS)]))
def q_cluster_zscores(spark, sf):
    out = I.cluster_zscores(_wc(spark, sf), "series", FEATS)
    return out.withColumns({"mean": r6("mean"), "z": r6("z")})


@query("cluster_minmax", V.with_views(
    """SELECT series, feature, round(mean, 6) AS mean,
              round((mean - min(mean) OVER (PARTITION BY feature))
                / CASE WHEN max(mean) OVER (PARTITION BY feature) - min(mean) OVER (PARTITION BY feature) = 0
                  THEN 1 ELSE max(mean) OVER (PARTITION BY feature) - min(mean) OVER (PARTITION BY feature) END,
                6) AS scaled FROM lm""",
    "w", ctes=[("wc", WC_SQL), ("lm", LONG_MEANS)]))
def q_cluster_minmax(spark, sf):
    out = I.cluster_minmax(_wc(spark, sf), "series", FEATS)
    return out.withColumns({"mean": r6("mean"), "scaled": r6("scaled")})


def _top_text_sql(col, n, fmt):
    return f"""SELECT series, string_agg({fmt} || ' (' || printf('%.1f%%', share * 100) || ')', ', '
                  ORDER BY rank) AS txt
       FROM (SELECT series, {col} AS value, count(*) / sum(count(*)) OVER (PARTITION BY series) AS share,
                    row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, {col}) AS rank
             FROM wc GROUP BY series, {col}) WHERE rank <= {n} GROUP BY series"""


DESCRIBE_SQL = f"""SELECT s.series, s.size, round(s.pct, 6) AS pct,
   printf('Cluster %s (%d points, %.1f%% of data)', s.series, s.size, s.pct) AS header,
   concat_ws('; ', {', '.join(f"printf('{c}: %.2f (Dataset Mean: %.2f)', m.{c}, a.all_{c})" for c in FEATS)})
     AS features,
   hh.txt AS common_hours, dd.txt AS common_days, ss.txt AS seasons,
   printf('Average: %.2f (Dataset Mean: %.2f); range %.2f - %.2f', t.tm, a.all_t, t.tmin, t.tmax) AS target_text
FROM (SELECT series, count(*) AS size, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM wc GROUP BY series) s
JOIN (SELECT series, {', '.join(f'avg({c}) AS {c}' for c in FEATS)} FROM wc GROUP BY series) m USING (series)
CROSS JOIN (SELECT {', '.join(f'avg({c}) AS all_{c}' for c in FEATS)}, avg(demand) AS all_t FROM wc) a
LEFT JOIN ({_top_text_sql('hour', 3, "CAST(value AS VARCHAR) || ':00'")}) hh USING (series)
LEFT JOIN ({_top_text_sql('day_of_week', 3, 'dayname(DATE ' + chr(39) + '2018-01-01' + chr(39) + ' + CAST(value AS INTEGER))')}) dd
  USING (series)
LEFT JOIN ({_top_text_sql('season', 2, 'value')}) ss USING (series)
JOIN (SELECT series, avg(demand) AS tm, min(demand) AS tmin, max(demand) AS tmax FROM wc GROUP BY series) t
  USING (series)"""


@query("describe_clusters", _q(DESCRIBE_SQL))
def q_describe_clusters(spark, sf):
    out = I.describe_clusters(_wc(spark, sf), "series", FEATS, season="season")
    return out.withColumn("pct", r6("pct")).drop(*[c for c in out.columns if c.startswith("_m_")])


REPORT_LINES = [f"printf('  {c}: %.4f', {c})" for c in FEATS] + [
    "'  Common hours: ' || common_hours", "'  Seasons: ' || seasons", "printf('  Average demand: %.2f', tm)"]
REPORT_BASE = DESCRIBE_SQL.replace("hh.txt AS common_hours", ", ".join(f"m.{c}" for c in FEATS) + ", t.tm, hh.txt AS common_hours")


@query("report_text", V.with_views(
    "SELECT series, 0 AS line_no, header || ':' AS line FROM b" + "".join(
        f"\nUNION ALL SELECT series, {i}, {line} FROM b" for i, line in enumerate(REPORT_LINES, 1)),
    "w", ctes=[("wc", WC_SQL), ("b", REPORT_BASE)]))
def q_report_text(spark, sf):
    return I.report_text(_wc(spark, sf), "series", FEATS)


PROFILE_SQL = """SELECT z.series, 'Cluster ' || z.series || ': ' || z.p || coalesce(d.txt, '') AS profile
FROM (SELECT series, string_agg(feature || ' (' || CASE WHEN zz > 0 THEN 'high' ELSE 'low' END || ')', ', '
                                ORDER BY rank) AS p
      FROM (SELECT series, feature, zz, row_number() OVER (PARTITION BY series
                   ORDER BY abs(zz) DESC NULLS LAST, feature) AS rank
            FROM (SELECT series, feature, (mean - avg(mean) OVER (PARTITION BY feature))
                         / nullif(stddev_samp(mean) OVER (PARTITION BY feature), 0) AS zz FROM lm))
      WHERE rank <= 3 GROUP BY series) z
LEFT JOIN (SELECT series, printf(', mostly during time_of_day=%s (%.1f%%)', value, share * 100) AS txt
           FROM (SELECT series, time_of_day AS value,
                        count(*) / sum(count(*)) OVER (PARTITION BY series) AS share,
                        row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, time_of_day) AS rank
                 FROM wc GROUP BY series, time_of_day) WHERE rank = 1 AND share > 0.4) d USING (series)"""


@query("cluster_profiles", V.with_views(PROFILE_SQL, "w", ctes=[("wc", WC_SQL), ("lm", LONG_MEANS)]))
def q_cluster_profiles(spark, sf):
    return I.cluster_profiles(_wc(spark, sf), "series", FEATS, categorical=["time_of_day"], top=3,
                              dominance=0.4)


@query("cluster_profiles_dominant", V.with_views(
    PROFILE_SQL.replace("share > 0.4", "share > 0.2"), "w", ctes=[("wc", WC_SQL), ("lm", LONG_MEANS)]))
def q_cluster_profiles_dominant(spark, sf):
    return I.cluster_profiles(_wc(spark, sf), "series", FEATS, categorical=["time_of_day"], top=3,
                              dominance=0.2)


# --- report sinks (S6, S7, F14, F16, F17) -------------------------------------------

@query("report_lines", _q(
    """SELECT printf('Cluster %s (%d points, %.1f%% of data)', series, count(*),
                     count(*) * 100.0 / sum(count(*)) OVER ()) AS line FROM wc GROUP BY series"""))
def q_report_lines(spark, sf):
    return I.describe_clusters(_wc(spark, sf), "series", FEATS, hour=None, dow=None,
                               target=None).select(F.col("header").alias("line"))


@query("to_json_report", _q(
    f"""SELECT to_json({{'series': series, 'ts': {G.ts_text('ts')}, 'windSpeed': windSpeed,
                       'demand': demand}}) AS record FROM wc"""))
def q_to_json_report(spark, sf):
    wc = _wc(spark, sf).select("series", ts_text("ts").alias("ts"), "windSpeed", "demand")
    return I.records_json(wc, ["series", "ts", "windSpeed", "demand"])
