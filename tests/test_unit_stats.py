"""Quantiles, profiling, cleaning, metrics, scalar rules."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from demandflow.functions import scalars as X
from demandflow.operators import clean as C
from demandflow.operators import features as FE
from demandflow.operators import metrics as M
from demandflow.operators import profile as P
from demandflow.operators.quantiles import quantiles

from conftest import MEDIUM


def test_quartiles_linear_interpolation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    q = {r["p"]: r["value"] for r in quantiles(df, ["x"], [0.25, 0.75]).collect()}
    assert q == {0.25: 1.75, 0.75: 5.25}


def test_quantiles_refinement_matches_numpy(spark):
    ev = spark.read.parquet(f"{MEDIUM}/events.parquet")
    pdf = ev.select("value", "event_type").toPandas()
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    for limit in (10 ** 9, 300, 20):       # no refinement, one round, several rounds
        got = quantiles(ev, ["value"], probs, keys=["event_type"], limit=limit, grid=50,
                        accuracy=1000).collect()
        for r in got:
            ref = np.percentile(pdf[pdf.event_type == r["event_type"]]["value"], r["p"] * 100)
            assert math.isclose(r["value"], ref, rel_tol=1e-12, abs_tol=1e-12)


def test_quantiles_heavy_ties(spark):
    vals = [1.0] * 500 + [2.0] * 3 + [3.0] * 200
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["p"]: r["value"] for r in quantiles(df, ["x"], [0.1, 0.5, 0.72, 0.9], limit=10,
                                                  grid=10, accuracy=100).collect()}
    for p, v in got.items():
        assert math.isclose(v, np.percentile(vals, p * 100))


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "r string")
    assert C.column_modes(df, ["r"]).first()["mode"] == "a"
    filled = C.impute_mode(df, ["r"]).collect()
    assert sorted(r["r"] for r in filled) == ["a", "a", "a", "b", "b"]


def test_impute_mean_treats_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert sorted(r["x"] for r in C.impute_mean(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    r = P.duplicate_count(df).first()
    assert (r["n_rows"], r["n_distinct"], r["n_duplicates"]) == (3, 2, 1)
    nc = {r["column"]: r["null_count"] for r in P.null_counts(df).collect()}
    assert nc == {"a": 0, "b": 2}


def test_iqr_and_capping(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    b = C.iqr_outliers(df, ["x"]).first()
    assert (b["q1"], b["q3"], b["n_outliers"]) == (2.0, 4.0, 1)
    capped = sorted((r["x"] for r in C.cap_outliers(df, ["x"]).collect()),
                    key=lambda v: (v is None, v))
    assert capped == [1.0, 2.0, 3.0, 4.0, 7.0, None]


def test_mape_skips_zero_actuals_and_r2(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0), (4.0, 2.0), (0.0, 0.0)], "actual double, predicted double")
    m = M.regression_metrics(df).first()
    assert math.isclose(m["mape"], (0.5 + 0.5) / 2 * 100)
    allzero = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "actual double, predicted double")
    assert M.regression_metrics(allzero).first()["mape"] is None


def test_negative_r2_normalised(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 1.0), (3.0, 0.0), (4.0, 5.0)],
                               "actual double, predicted double")
    n = M.normalized_metrics(M.regression_metrics(df)).first()
    assert n["r2"] < 0 and math.isclose(n["r2_norm"], (n["r2"] + 1) / 2)
    s = M.performance_score(M.normalized_metrics(M.regression_metrics(df))).first()
    assert s["performance_grade"] in ("Poor", "Fair")


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    out = FE.standardize(df, ["a", "c"]).collect()
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0]
    assert math.isclose(out[0]["a"], -1 / math.sqrt(2 / 3))     # population std


def test_monday_is_zero_and_names(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 1, 1, 5),)], "ts timestamp_ntz")
    r = FE.day_names(FE.season_time_of_day(FE.calendar_features(df))).first()
    assert (r["day_of_week"], r["is_weekend"], r["season"], r["time_of_day"], r["day_name"]) == \
        (0, 0, "Winter", "Night", "Monday")


def test_grades(spark):
    df = spark.createDataFrame([(x,) for x in (0.95, 0.8, 0.65, 0.45, 0.1)], "s double")
    got = [r[0] for r in df.select(X.performance_grade("s")).collect()]
    assert got == ["Excellent", "Good", "Satisfactory", "Fair", "Poor"]


def test_correlation_diagonal(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9)], "a double, b double")
    c = {(r["column_a"], r["column_b"]): r["corr"] for r in P.correlation_matrix(df).collect()}
    assert math.isclose(c[("a", "a")], 1.0) and c[("a", "b")] == c[("b", "a")]


def test_parse_time_bad_text_is_null(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00",), ("bad",)], "s string")
    out = C.parse_time(df, "s", "t", fmt="yyyy-MM-dd HH:mm:ss").collect()
    assert out[0]["t"] == dt.datetime(2024, 1, 1, 1) and out[1]["t"] is None


def test_resolve_features_prefers_apparent(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "temperature double, apparentTemperature double, x double")
    assert C.resolve_features(df, ["temperature", "x", "missing"]) == ["apparentTemperature", "x"]
    try:
        C.require_columns(df, ["demand"])
        raise AssertionError("expected ValueError")
    except ValueError:
        pass
