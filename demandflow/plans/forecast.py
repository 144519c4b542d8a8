"""Forecast pipelines composed from the operators (the batch script 2 and the
forecast request of the web app, for many series at once)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.operators import metrics as M
from demandflow.operators import series as S


def naive_forecast_metrics(df: DataFrame, keys="series", ts="ts", target="demand",
                           lags=(1, 24), windows=(6, 12, 24), season=24,
                           train_frac=0.8, **layout) -> DataFrame:
    """Lag / rolling features -> drop incomplete rows -> chronological split
    -> seasonal-naive forecast on the test rows -> metrics per series."""
    feats = S.series_features(df, keys, ts, target, lags=lags, windows=windows, **layout)
    bound = S.series_max_rows(feats)            # dropping rows keeps series within it
    split = S.chrono_split(feats.dropna(how="any"), keys, ts, train_frac=train_frac,
                           max_rows=bound, **layout)
    test = (split.where(F.col("split") == "test")
                 .withColumn("predicted", F.col(f"{target}_lag{season}")))
    return M.regression_metrics(test, keys, actual=target, predicted="predicted")


# Fixed forecasters compared by the evaluation queries: the seasonal-naive
# baseline and three other window-based predictions of the same series.
BASELINE = "naive"
FORECASTERS = {
    "naive": "demand_lag24",          # value 24 rows earlier (W6)
    "last_value": "demand_lag1",
    "weekly": "demand_lag168",
    "mean24": "demand_prev24_mean",   # mean of the 24 preceding rows
}


def complete_rows(df: DataFrame, keys="series", ts="ts", target="demand",
                  **layout) -> tuple[DataFrame, int | None]:
    """The rows every forecaster is fitted and scored on: window features added,
    rows with an incomplete one dropped; and the bound of rows per series."""
    keys = [keys] if isinstance(keys, str) else list(keys)

    def build(w):
        return {"demand_lag1": F.lag(target, 1).over(w),
                "demand_lag24": F.lag(target, 24).over(w),
                "demand_lag168": F.lag(target, 168).over(w),
                "demand_prev24_mean": F.avg(target).over(w.rowsBetween(-24, -1))}
    feats = S.with_series_windows(df.select(*keys, ts, target), keys, ts, 168, build, **layout)
    return feats.dropna(how="any"), S.series_max_rows(feats)


def forecaster_predictions(df: DataFrame, keys="series", ts="ts", target="demand",
                           train_frac=0.8, **layout) -> DataFrame:
    """Long table (keys, ts, split, model, actual, predicted) over the test
    rows of each series, after dropping rows whose features are incomplete
    (as ``dropna`` before the split)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows, bound = complete_rows(df, keys, ts, target, **layout)
    split = S.chrono_split(rows, keys, ts, train_frac=train_frac, max_rows=bound, **layout)
    test = split.where(F.col("split") == "test")
    stacked = F.stack(F.lit(len(FORECASTERS)), *[x for m, c in FORECASTERS.items()
                                                 for x in (F.lit(m), F.col(c))])
    return test.select(*keys, ts, F.col(target).alias("actual"),
                       stacked.alias("model", "predicted"))


def linear_one_feature(df: DataFrame, keys="series", ts="ts", target="demand",
                       feature="demand_lag1", train_frac=0.8, **layout) -> DataFrame:
    """Per series: least-squares line of the target on one feature over the
    train rows (``regr_slope`` / ``regr_intercept``, grouped aggregates),
    then metrics of its predictions on the test rows (M1, one-feature form)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows, bound = complete_rows(df, keys, ts, target, **layout)
    split = S.chrono_split(rows, keys, ts, train_frac=train_frac, max_rows=bound, **layout).persist()  # two branches
    coef = (split.where(F.col("split") == "train").groupBy(*keys)
                 .agg(F.regr_slope(target, feature).alias("slope"),
                      F.regr_intercept(target, feature).alias("intercept")))
    test = (split.where(F.col("split") == "test").join(coef, keys)
                 .withColumn("predicted", F.col("intercept") + F.col("slope") * F.col(feature)))
    m = M.regression_metrics(test, keys, actual=target, predicted="predicted")
    return coef.join(m, keys)
