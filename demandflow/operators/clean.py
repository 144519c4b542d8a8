"""Cleaning (L1-L9, S2-S4): imputation, null and duplicate removal, IQR
outlier counting and capping, time parsing, column resolution.

Statistics used to fill or cap (means, modes, bounds) are fitted like a
Spark ML estimator: one aggregate yields one value per column (a size fixed
by the column count), applied to the rows as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandflow.functions.scalars import EPOCH_NTZ
from demandflow.operators.profile import describe, numeric_columns, string_columns
from demandflow.operators.quantiles import quantile_wide


# --- column checks (S2-S4) ---------------------------------------------------

def require_columns(df: DataFrame, required: Sequence[str],
                    alternatives: dict[str, str] | None = None) -> None:
    """Raise ``ValueError`` when a required column is missing and has no
    alternative present (S2)."""
    alternatives = alternatives or {}
    missing = [c for c in required
               if c not in df.columns and alternatives.get(c) not in df.columns]
    if missing:
        raise ValueError(f"required columns not found: {missing}")


def resolve_columns(df: DataFrame, fallbacks: dict[str, str] | None = None) -> DataFrame:
    """Copy a fallback column into a missing one (S3): by default
    ``temperature`` from ``apparentTemperature``."""
    fallbacks = fallbacks if fallbacks is not None else {"temperature": "apparentTemperature"}
    add = {t: F.col(s) for t, s in fallbacks.items() if t not in df.columns and s in df.columns}
    return df.withColumns(add) if add else df


def resolve_features(df: DataFrame, wanted: Sequence[str],
                     prefer: dict[str, str] | None = None) -> list[str]:
    """Wanted feature names that exist, with preferred substitutes (S4):
    by default ``apparentTemperature`` replaces ``temperature`` if present."""
    prefer = prefer if prefer is not None else {"temperature": "apparentTemperature"}
    out = []
    for c in wanted:
        alt = prefer.get(c)
        pick = alt if alt in df.columns else c
        if pick in df.columns and pick not in out:
            out.append(pick)
    return out


# --- imputation (L2, L3) -----------------------------------------------------

def _nan_to_null(c: str, dt) -> Column:
    col = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.nanvl(col, F.lit(None).cast(dt))
    return col


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: the mean of each column (nulls and NaN skipped)."""
    return df.agg(*[F.avg(_nan_to_null(c, df.schema[c].dataType)).alias(c) for c in cols])


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls (and NaN) of numeric columns with the column mean (L2).
    Fit/transform like ``Imputer``: one aggregate gives one value per
    column, applied as literals. Integer columns become double, so a
    fractional mean is kept."""
    cols = list(cols or numeric_columns(df))
    means = column_means(df, cols).first()             # one value per column

    def filled(c):
        dt = df.schema[c].dataType
        to = dt if isinstance(dt, (T.FloatType, T.DoubleType)) else T.DoubleType()
        mean = F.lit(None if means[c] is None else float(means[c])).cast(to)
        return F.coalesce(_nan_to_null(c, dt).cast(to), mean)
    return df.withColumns({c: filled(c) for c in cols})


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (column, mode): the most frequent non-null value, the
    smallest among ties (``mode()[0]``).

    Two aggregation steps instead of a holistic ``mode``: count per
    (column, value) with map-side combining, then pick per column. No task
    ever holds more than its share of distinct values.
    """
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
              .unpivot([], list(cols), "column", "value")
              .where(F.col("value").isNotNull()))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
         .alias("mode"))


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls of (string) columns with the column mode (L3)."""
    cols = list(cols or string_columns(df))
    modes = {r["column"]: r["mode"] for r in column_modes(df, cols).collect()}   # one per column
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes.get(c)).cast(df.schema[c].dataType))
                           for c in cols})


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (or any listed) column (L4)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Keep one copy of each row (L5); map-side dedup before the shuffle."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns if present (L1)."""
    return df.drop(*[c for c in cols if c in df.columns])


# --- outliers (L6-L8) --------------------------------------------------------

def iqr_bounds(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
               factor: float = 1.5) -> DataFrame:
    """Exact Q1/Q3, IQR and the bounds Q1 - f*IQR, Q3 + f*IQR per column."""
    q = quantile_wide(df, cols, (0.25, 0.75), keys, names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, "column", "q1", "q3", iqr.alias("iqr"),
                    (F.col("q1") - factor * iqr).alias("lower"),
                    (F.col("q3") + factor * iqr).alias("upper"))


def _bounds(bounds: DataFrame) -> dict[str, tuple[float, float]]:
    """(lower, upper) per column: one row per column."""
    return {r["column"]: (r["lower"], r["upper"]) for r in bounds.collect()}


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Per column: bounds, number and percent of values strictly outside
    (L6). Two passes: exact quartiles, then one counting aggregate."""
    cols = list(cols or numeric_columns(df))
    bounds = iqr_bounds(df, cols, factor=factor).persist()
    b = _bounds(bounds)

    def outside(c):                      # NaN counts as missing; no bounds, no outlier
        x, (low, high) = _nan_to_null(c, df.schema[c].dataType), b.get(c, (None, None))
        return (x < F.lit(low).cast("double")) | (x > F.lit(high).cast("double"))
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(outside(c)).alias(f"_out_{c}") for c in cols])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_out_{c}").alias("n_outliers"))
                        for c in cols])
    counts = counted.select("_rows", F.inline(entries))
    return (counts.join(bounds, "column", "left")
                  .select("column", "q1", "q3", "iqr", "lower", "upper", "n_outliers", "_rows")
                  .withColumn("pct_outliers", F.col("n_outliers") / F.col("_rows") * 100)
                  .drop("_rows"))


def cap_outliers(df: DataFrame, cols: Sequence[str] | None = None, factor: float = 1.5,
                 bounds: DataFrame | None = None) -> DataFrame:
    """Clip each column to its IQR bounds (L7). Nulls stay null and NaN, which
    counts as missing, becomes null; a column without values is left as it is."""
    cols = list(cols or numeric_columns(df))
    bounds = bounds if bounds is not None else iqr_bounds(df, cols, factor=factor)
    b = _bounds(bounds)

    def capped(c):
        if c not in b or b[c][0] is None:
            return F.col(c)
        x = _nan_to_null(c, df.schema[c].dataType)
        # greatest/least skip nulls, so a null is kept explicitly
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(b[c][0])), F.lit(b[c][1])))
    return df.withColumns({c: capped(c) for c in cols})


def capping_report(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    """min, max, mean, std of each column before and after capping."""
    capped = cap_outliers(df, cols, factor)
    keep = ["column", "min", "max", "mean", "std"]
    before = describe(df, cols).select(*keep)
    after = describe(capped, cols).select(*keep)
    return before.join(after.select("column", *[F.col(c).alias(f"{c}_capped") for c in keep[1:]]),
                       "column")


# --- time parsing (L9) -------------------------------------------------------

def parse_time(df: DataFrame, col: str, name: str = "time", unit: str = "s",
               fmt: str | None = None) -> DataFrame:
    """Timestamp from unix numbers (``unit`` s/ms/us) or from text; text that
    does not parse becomes null instead of failing the job (Q16, N13)."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        out = c.cast("timestamp_ntz")
    elif isinstance(dt, T.DateType):
        out = c.cast("timestamp_ntz")
    elif isinstance(dt, NUMERIC_TYPES):
        # unix time as UTC wall clock, independent of the session time zone
        per = {"s": 1_000_000, "ms": 1_000, "us": 1}[unit]
        out = F.timestamp_add("MICROSECOND", (c * F.lit(per)).cast("long"),
                              F.lit(EPOCH_NTZ).cast("timestamp_ntz"))
    else:
        parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
        out = parsed.cast("timestamp_ntz")
    return df.withColumn(name, out)


def pick_time_column(df: DataFrame, candidates: Sequence[str] = ("time", "local_time")) -> str:
    """First time column present (``time``, else ``local_time``)."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no time column among {list(candidates)}")


NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
