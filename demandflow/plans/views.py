"""Derived input views over the test tables, in Spark and as DuckDB SQL.

The reference works on one hourly table of demand plus weather. The test
tables hold no such table, so the views below derive one (see FIXTURES.md):

- H: hourly demand per series from ``events``
- W: H plus weather-like hourly columns
- D: ``events`` with injected nulls, duplicate rows and time strings
- O: daily order totals per priority
- V: ``embeddings`` (vectors with labels)

Each view exists twice with the same definition: a DataFrame builder and a
SQL text used by the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.functions.scalars import epoch_micros, trunc_ntz


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hour(ts):
    return trunc_ntz(ts, "hour")


def hourly(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """With ``start``/``end`` (hours wanted, inclusive) the equivalent range of the stored
    time is filtered before the aggregate, so that it reaches the scan."""
    ev = table(spark, sf_dir, "events")
    if start is not None:
        ev = ev.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        ev = ev.where(F.col("ts") < F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR"))
    return (ev.groupBy(F.col("event_type").alias("series"), _hour(F.col("ts")).alias("ts"))
              .agg(F.round(F.sum("value"), 2).alias("demand")))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")

    def share(cond):
        return F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 6)

    return (ev.groupBy(F.col("event_type").alias("series"), _hour(F.col("ts")).alias("ts"))
              .agg(F.round(F.sum("value"), 2).alias("demand"),
                   F.round(F.avg("value"), 6).alias("temperature"),
                   F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("precipIntensity"),
                   share(F.col("value") > 50).alias("precipProbability"),
                   share(F.col("value") < 20).alias("cloudCover"),
                   share(F.col("user_id") % 3 == 0).alias("humidity"),
                   F.max("value").alias("windSpeed")))


def dirty_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every events row, with nulls in ``ozone``/``region`` and unparsable
    time strings."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    base = ev.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.when(eid % 10 == 3, F.lit(None).cast("double")).otherwise(F.col("value")).alias("ozone"),
        F.when(eid % 10 == 7, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string"))).alias("region"),
        F.floor(epoch_micros("ts") / 1_000_000).alias("time_s"),
        F.when(eid % 100 == 9, F.lit("bad"))
         .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time_str"),
    )
    return base


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dirty_base`` plus 2% of its rows appended a second time as exact
    duplicates."""
    base = dirty_base(spark, sf_dir)
    return base.unionAll(base.where(F.col("event_id") % 50 == 0))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("series"),
                      trunc_ntz("o_orderdate", "day").alias("ts"))
             .agg(F.round(F.sum("o_totalprice"), 2).alias("demand")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


# --- the same views as DuckDB SQL -------------------------------------------

SQL = {
    "h": """SELECT event_type AS series, date_trunc('hour', ts) AS ts,
               round(sum(value), 2) AS demand
        FROM events GROUP BY 1, 2""",
    "w": """SELECT event_type AS series, date_trunc('hour', ts) AS ts,
               round(sum(value), 2) AS demand,
               round(avg(value), 6) AS temperature,
               round(coalesce(stddev_samp(value), 0), 6) AS precipIntensity,
               round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS precipProbability,
               round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END), 6) AS cloudCover,
               round(avg(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS humidity,
               max(value) AS windSpeed
        FROM events GROUP BY 1, 2""",
    "d_base": """SELECT event_id, ts, user_id, event_type, value,
               CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS ozone,
               CASE WHEN event_id % 10 = 7 THEN NULL ELSE 'R' || CAST(user_id % 5 AS VARCHAR) END AS region,
               CAST(epoch_us(ts) // 1000000 AS BIGINT) AS time_s,
               CASE WHEN event_id % 100 = 9 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time_str
        FROM events""",
    "d": """SELECT * FROM d_base UNION ALL SELECT * FROM d_base WHERE event_id % 50 = 0""",
    "o": """SELECT o_orderpriority AS series, date_trunc('day', o_orderdate) AS ts,
               round(sum(o_totalprice), 2) AS demand
        FROM orders GROUP BY 1, 2""",
}

_DEPS = {"d": ["d_base"]}


def with_views(sql: str, *names: str, ctes: list[tuple[str, str]] = ()) -> str:
    """Prefix ``sql`` with CTEs for the named views (h, w, d, o), followed by
    the extra ``(name, sql)`` CTEs in the order given."""
    order: list[str] = []
    for n in names:
        for dep in _DEPS.get(n, []) + [n]:
            if dep not in order:
                order.append(dep)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + sql
