"""Window features, splits and the chunked (skew-safe) series layout."""

import math

import pytest
from pyspark.sql import functions as F

from demandflow.operators import series as S
from demandflow.plans import views as V

from conftest import SMALL


def _frame(spark, values, series="a"):
    return spark.createDataFrame([(series, i, v) for i, v in enumerate(values)],
                                 "series string, t long, y double")


def test_rolling_with_null_inside_window(spark):
    df = _frame(spark, [1.0, None, 4.0, 8.0])
    out = S.rolling_features(df, "series", "t", "y", windows=(3,)).orderBy("t").collect()
    assert [r["y_roll3_mean"] for r in out] == [1.0, 1.0, 2.5, 6.0]
    stds = [r["y_roll3_std"] for r in out]
    assert stds[:2] == [0.0, 0.0]
    assert math.isclose(stds[2], 2.1213203, rel_tol=1e-6)
    assert math.isclose(stds[3], 2.8284271, rel_tol=1e-6)


def test_one_row_series_and_short_series(spark):
    df = _frame(spark, [5.0]).unionByName(_frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0], "b"))
    out = S.series_features(df, "series", "t", "y", lags=(1, 24), windows=(3,))
    one = out.where("series = 'a'").first()
    assert one["y_roll3_std"] == 0.0 and one["y_lag1"] is None
    assert out.where("series = 'b'").dropna().count() == 0      # shorter than lag 24


def test_chrono_split_and_tail(spark):
    df = _frame(spark, [float(i) for i in range(23)])
    sp = S.chrono_split(df, "series", "t").orderBy("t").collect()
    assert sum(r["split"] == "train" for r in sp) == 18         # int(23 * 0.8)
    assert [r["t"] for r in S.tail_rows(df, "series", "t", 3).collect()] == [20, 21, 22]


def test_stacking_folds_sizes(spark):
    df = _frame(spark, [float(i) for i in range(23)])
    folds = S.stacking_folds(df, "series", "t").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [5, 5, 5, 4, 4]


@pytest.mark.parametrize("chunk", [50, 137])
def test_chunked_layout_equals_single_window(spark, chunk):
    h = V.hourly(spark, SMALL)
    plain = S.series_features(h, "series", "ts", "demand", lags=(1, 24), windows=(6, 24))
    chunked = S.series_features(h, "series", "ts", "demand", lags=(1, 24), windows=(6, 24),
                                chunk_rows=chunk, bucket_width=3600 * 5)
    cols = plain.columns
    a = sorted(tuple(r) for r in plain.select(*cols).collect())
    b = sorted(tuple(r) for r in chunked.select(*cols).collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert (u is None and v is None) or u == v or math.isclose(u, v, rel_tol=1e-9)


def test_chunked_split_equals_single_window(spark):
    h = V.hourly(spark, SMALL)
    a = sorted(tuple(r) for r in S.chrono_split(h, "series", "ts").collect())
    b = sorted(tuple(r) for r in S.chrono_split(h, "series", "ts", chunk_rows=40).collect())
    assert a == b


def test_time_order_report_counts_gaps(spark):
    df = spark.createDataFrame([("a", 0), ("a", 3600), ("a", 3600), ("a", 4 * 3600)],
                               "series string, s long").withColumn(
        "ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    r = S.time_order_report(df, "series", "ts").first()
    assert (r["n_rows"], r["n_repeated_ts"], r["n_gaps"], r["max_step_seconds"]) == (4, 1, 1, 10800)


def test_hot_hour_in_hot_series_is_split(spark):
    """One series holds most rows and one hour of it holds half of them:
    buckets are refined so no chunk overfills, and results equal the plain
    single-window plan."""
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [("hot", base + dt.timedelta(milliseconds=300 * i), float(i % 97)) for i in range(6000)]
    rows += [("hot", base + dt.timedelta(hours=2 + i), float(i)) for i in range(3000)]
    rows += [("cold", base + dt.timedelta(hours=i), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double")
    plain = S.series_features(df, "series", "ts", "y", lags=(1, 3), windows=(4,))
    chunked = S.series_features(df, "series", "ts", "y", lags=(1, 3), windows=(4,), chunk_rows=1000)
    frame, _ = S.index_series(df, "series", "ts", halo=3, chunk_rows=1000)
    biggest = frame.groupBy("series", S.CHUNK).count().agg(F.max("count")).first()[0]
    assert biggest <= 1000 + 3 + 500          # a chunk plus halo, never the hot hour whole
    cols = plain.columns
    a = sorted(tuple(r) for r in plain.select(*cols).collect())
    b = sorted(tuple(r) for r in chunked.select(*cols).collect())
    assert a == b


def test_hot_exact_timestamp_is_split(spark):
    """A third of a series' rows share one exact timestamp: they are spread
    over several chunks, every row keeps a unique position, and lags follow
    the same order as the positions."""
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [("hot", base + dt.timedelta(minutes=i), float(i)) for i in range(4000)]
    rows += [("hot", base + dt.timedelta(minutes=1000), 10_000.0 + i) for i in range(2000)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double")
    frame, w = S.index_series(df, "series", "ts", halo=1, chunk_rows=800)
    sizes = frame.groupBy(S.CHUNK).count().agg(F.max("count")).first()[0]
    assert sizes <= 800 + 1 + 200
    own = frame.where(~F.col(S.HALO))
    assert own.select(S.ROW).distinct().count() == 6000
    assert own.agg(F.min(S.ROW), F.max(S.ROW)).first() == (0, 5999)
    lagged = (frame.withColumn("prev_row", F.lag(S.ROW, 1).over(w))
                   .withColumn("prev_ts", F.lag("ts", 1).over(w)).where(~F.col(S.HALO)))
    assert lagged.where(F.col("prev_row").isNotNull()
                        & (F.col("prev_row") != F.col(S.ROW) - 1)).count() == 0
    assert lagged.where(F.col("prev_ts") > F.col("ts")).count() == 0      # time order kept
    plain = S.series_features(df, "series", "ts", "y", lags=(1,), windows=(2,))
    chunked = S.series_features(df, "series", "ts", "y", lags=(1,), windows=(2,), chunk_rows=800)
    # outside the tied minute the results are identical
    keep = F.col("ts") != F.lit(base + dt.timedelta(minutes=1000))
    a = sorted(tuple(r) for r in plain.where(keep).where(
        F.col("ts") != F.lit(base + dt.timedelta(minutes=1001))).collect())
    b = sorted(tuple(r) for r in chunked.where(keep).where(
        F.col("ts") != F.lit(base + dt.timedelta(minutes=1001))).collect())
    assert a == b
