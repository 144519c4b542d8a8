"""Column expressions (F1-F17): calendar, weather, cyclical, grading, text.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x) -> Column:
    """Round a double to 6 decimals (results compared across engines)."""
    return F.round(_c(x), 6)


# --- calendar (F1-F4, F13) ---------------------------------------------------

def hour(ts) -> Column:
    return F.hour(_c(ts))


def day(ts) -> Column:
    return F.dayofmonth(_c(ts))


def month(ts) -> Column:
    return F.month(_c(ts))


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def is_weekend(dow) -> Column:
    return F.when(_c(dow) >= 5, 1).otherwise(0)


def season(month_col) -> Column:
    m = _c(month_col)
    return (F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
             .when(m.isin(6, 7, 8), "Summer").otherwise("Fall"))


def time_of_day(hour_col) -> Column:
    h = _c(hour_col)
    return (F.when(h < 6, "Night").when(h < 12, "Morning")
             .when(h < 18, "Afternoon").otherwise("Evening"))


# Day names for Monday = 0 ... Sunday = 6.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def day_name(dow) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), _c(dow) + 1)


# --- weather (F5-F7) -----------------------------------------------------------

def heat_index(temp, humidity) -> Column:
    t, h = _c(temp), _c(humidity)
    return F.when(h < 0.4, t).otherwise(t + 0.5 * (h * 10))


def above_half(x) -> Column:
    return F.when(_c(x) > 0.5, 1).otherwise(0)


# --- cyclical (F8) -----------------------------------------------------------

def cyc_sin(x, period) -> Column:
    return F.sin(2 * math.pi * _c(x) / period)


def cyc_cos(x, period) -> Column:
    return F.cos(2 * math.pi * _c(x) / period)


# --- scores and text (F12, F15) ------------------------------------------------

def iso_utc(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Grade thresholds, highest first.
GRADES = [(0.9, "Excellent"), (0.75, "Good"), (0.6, "Satisfactory"), (0.4, "Fair")]


def performance_grade(score) -> Column:
    s = _c(score)
    out = None
    for cut, name in GRADES:
        out = F.when(s >= cut, name) if out is None else out.when(s >= cut, name)
    return out.otherwise("Poor")


def trunc_ntz(ts, unit: str) -> Column:
    """Wall-clock truncation of a timestamp to 'hour' or 'day' as
    TIMESTAMP_NTZ, built from its fields so no session time zone is
    involved."""
    t = _c(ts)
    h = F.hour(t) if unit == "hour" else F.lit(0)
    if unit not in ("hour", "day"):
        raise ValueError(unit)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), h, F.lit(0), F.lit(0))


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of the wall-clock value (no time
    zone involved for TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), _c(ts))


def ts_text(ts) -> Column:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss' text (query outputs compared
    across engines)."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")
