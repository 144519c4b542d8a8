"""Row-wise feature columns (F1-F8, F13) and scaling.

All are built-in expressions evaluated inside whole-stage codegen; none
needs a shuffle except the scaler's one-row statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.functions import scalars as X

# Cyclical periods of the reference (hour 24, day of week 7, month 12).
CYCLE_PERIODS = {"hour": 24, "day_of_week": 7, "month": 12}


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, day, month, day_of_week (Monday 0), is_weekend; columns already
    present are kept as they are (F1, F2)."""
    add = {}
    for name, fn in (("hour", X.hour), ("day", X.day), ("month", X.month),
                     ("day_of_week", X.day_of_week)):
        if name not in df.columns:
            add[name] = fn(ts)
    out = df.withColumns(add) if add else df
    if "is_weekend" not in out.columns:
        out = out.withColumn("is_weekend", X.is_weekend("day_of_week"))
    return out


def season_time_of_day(df: DataFrame, month: str = "month", hour: str = "hour") -> DataFrame:
    """``season`` from the month, ``time_of_day`` from the hour."""
    return df.withColumns({"season": X.season(month), "time_of_day": X.time_of_day(hour)})


def weather_features(df: DataFrame, temp: str = "temperature", humidity: str = "humidity",
                     rain: str = "precipProbability", cloud: str = "cloudCover") -> DataFrame:
    """heat_index, is_rainy, is_cloudy, temp_humidity_interaction."""
    return df.withColumns({
        "heat_index": X.heat_index(temp, humidity),
        "is_rainy": X.above_half(rain),
        "is_cloudy": X.above_half(cloud),
        "temp_humidity_interaction": F.col(temp) * F.col(humidity),
    })


def cyclical_features(df: DataFrame, periods: dict[str, int] | None = None) -> DataFrame:
    """``<col>_sin`` / ``<col>_cos`` for each column and period (F8)."""
    periods = periods or CYCLE_PERIODS
    add = {}
    for c, p in periods.items():
        if c in df.columns:
            add[f"{c}_sin"] = X.cyc_sin(c, p)
            add[f"{c}_cos"] = X.cyc_cos(c, p)
    return df.withColumns(add)


def day_names(df: DataFrame, dow: str = "day_of_week", name: str = "day_name") -> DataFrame:
    """Day number (Monday 0) to its English name."""
    return df.withColumn(name, X.day_name(dow))


# --- standard scaling (C1, rule N4) ------------------------------------------

def scaler_stats(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population std of each column (per group), std 0 -> 1,
    as ``StandardScaler``. One row (per group), one column pair per feature."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    st = df.groupBy(*keys).agg(*aggs)
    return st.withColumns({f"{c}__scale": F.when((F.col(f"{c}__std") == 0) | F.col(f"{c}__std").isNull(),
                                                  F.lit(1.0)).otherwise(F.col(f"{c}__std"))
                           for c in cols}).drop(*[f"{c}__std" for c in cols])


def _attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    # without keys the statistics are one row (two values per feature),
    # applied as literals; with keys one row per group, joined by key
    # (broadcast is left to AQE's measured size)
    if keys:
        return df.join(stats, list(keys), "left")
    row = stats.first().asDict()
    return df.withColumns({k: F.lit(v).cast("double") for k, v in row.items()})


def standardize(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None,
                keys: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """(x - mean) / std with statistics fitted on ``stats`` (e.g. the train
    rows) or on ``df`` itself."""
    stats = stats if stats is not None else scaler_stats(df, cols, keys)
    out = _attach(df, stats, keys)
    out = out.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__scale")
                           for c in cols})
    return out.drop(*[f"{c}__{s}" for c in cols for s in ("mean", "scale")])


def unstandardize(df: DataFrame, cols: Sequence[str], stats: DataFrame,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Inverse of :func:`standardize` (cluster centres in original units)."""
    out = _attach(df, stats, keys)
    out = out.withColumns({c: F.col(c) * F.col(f"{c}__scale") + F.col(f"{c}__mean") for c in cols})
    return out.drop(*[f"{c}__{s}" for c in cols for s in ("mean", "scale")])
