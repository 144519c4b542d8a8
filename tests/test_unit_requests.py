"""The forecast and segmentation requests on frames of their own."""

import datetime as dt
import math

import numpy as np
import pytest

from demandflow.operators import requests as RQ


@pytest.fixture(scope="module")
def hours(spark):
    """Two long series and a short one; text times, missing values."""
    rows = []
    for name, n in (("North", 260), ("south", 230), ("tiny", 30)):
        for i in range(n):
            t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
            rows.append((name, t.strftime("%Y-%m-%d %H:%M:%S"), 100 + 20 * math.sin(i * math.pi / 12) + i % 5,
                         None if i % 17 == 3 else 10.0 + i % 24, None if i % 29 == 1 else "x"))
    return spark.createDataFrame(rows, "city string, time string, demand double, temperature double, kind string").persist()


def test_forecast_of_every_series(hours):
    r = RQ.Forecast(hours, ["Naive", "Linear"], key="city", lookback=24)
    assert r.features[0] == "temperature" and "demand_lag168" in r.features
    got = {(x.city, x.model): x for x in r.metrics().collect()}
    assert got["tiny", None].reason == "no complete rows" and len(got) == 5
    assert got["North", "Naive"].n == 19 and got["south", "Naive"].n == 13            # a fifth of 92 and of 62
    assert got["North", "Linear"].mae < got["North", "Naive"].mae and got["North", "Linear"].rank == 1
    pts = r.points().where("model = 'Naive' AND city = 'North'").collect()
    by_time = {x.time: x.demand for x in hours.where("city = 'North'").collect()}
    for p in pts:
        t = dt.datetime.strptime(p.date, "%Y-%m-%dT%H:%M:%SZ")
        assert p.actual == by_time[str(t)] and p.predicted == by_time[str(t - dt.timedelta(hours=24))]


def test_forecast_filters_and_guards(hours):
    one = RQ.Forecast(hours, ["Naive"], key="city", value="NORTH", start="2024-01-02 00:00:00", end="2024-01-10 23:00:00", lookback=6)
    got = one.metrics().collect()
    assert [(x.city, x.n) for x in got] == [("North", 35)]            # 216 hours less 42, the last fifth
    none = RQ.Forecast(hours, ["Naive", "Linear", "ARIMA"], key="city", value="tiny")
    assert [x.reason for x in none.metrics().collect()] == ["no complete rows"] and none.points().count() == 0
    for bad in (dict(models=["Prophet"]), dict(models=[]), dict(key="region"), dict(target="load"), dict(value="nowhere")):
        with pytest.raises(ValueError):
            RQ.Forecast(hours, **{"key": "city", **bad})
    with pytest.raises(ValueError):
        RQ.Forecast(hours.drop("time"), key="city")


def test_unix_seconds_are_times(hours, spark):
    rows = [("a", 1_704_067_200 + 3600 * i, float(i % 24)) for i in range(120)]
    df = spark.createDataFrame(rows, "series string, local_time long, demand double")
    pts = RQ.Forecast(df, ["Naive"], lookback=6).points().orderBy("date").collect()
    assert pts[0].date == "2024-01-05T08:00:00Z" and len(pts) == 16


def test_segments(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(c[0] + a), float(c[1] + b)) for i, (c, a, b) in enumerate(
        (c, *rng.normal(0, 0.2, 2)) for c in ((0, 0), (10, 0), (0, 300)) for _ in range(40))]
    df = spark.createDataFrame(rows, "id long, temperature double, precipIntensity double")
    out = RQ.Segments(df, k=None, keep=["id"], ks=range(2, 6), n_init=3)
    assert out.k == 3 and out.features == ["precipIntensity", "temperature"] and out.silhouette > 0.9
    centres = sorted((round(r.temperature), round(r.precipIntensity)) for r in out.centres.collect())
    assert centres == [(0, 0), (0, 300), (10, 0)]
    pts = out.points().collect()
    assert len(pts) == 120 and len({(r.id // 40, r.label) for r in pts}) == 3
    lines = [r.line for r in out.score_lines().orderBy("line_no").collect()]
    assert len(lines) == 8 and lines[-2].endswith(": 3") and lines[2].startswith("K = 2: 0.")


def test_segments_without_a_silhouette(spark):
    same = spark.createDataFrame([(i, 5.0) for i in range(6)], "id long, temperature double")
    out = RQ.Segments(same, k=2)
    assert out.silhouette == -1.0 and out.centres.count() == 1 and out.points().count() == 6
    few = RQ.Segments(same.withColumn("temperature", same.id.cast("double")).limit(2), k=2)
    assert few.silhouette == -1.0                                       # not more rows than k
    none = RQ.Segments(same.limit(0), k=2)
    assert (none.silhouette, none.centres.count(), none.points().count()) == (-1.0, 0, 0)
    assert RQ.Segments(same.withColumnRenamed("temperature", "apparentTemperature"), k=2).features == ["apparentTemperature"]
    with pytest.raises(ValueError):
        RQ.Segments(same.drop("temperature"))
