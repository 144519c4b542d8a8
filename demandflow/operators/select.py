"""Key listing, filters and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_series(df: DataFrame, col: str, default: str | None = "All") -> DataFrame:
    """Distinct non-null keys, plus a default entry flagged ``is_default``
    (S8). Sort with ``orderBy(~is_default, col)`` to list the default first."""
    keys = (df.select(F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull())
              .distinct().withColumn("is_default", F.lit(False)))
    if default is None:
        return keys
    first = df.sparkSession.range(1).select(F.lit(default).alias(col),
                                            F.lit(True).alias("is_default"))
    return first.unionByName(keys)


def filter_series(df: DataFrame, col: str, value: str | None, check: bool = False) -> DataFrame:
    """Case-insensitive equality on a key (P3); ``None`` keeps everything.
    With ``check``, raise when nothing is left (one short job)."""
    if value is None or col not in df.columns:
        return df
    out = df.where(F.lower(F.col(col)) == F.lower(F.lit(value)))
    if check and out.isEmpty():
        raise ValueError(f"no rows for {col} = {value!r}")
    return out


def filter_time(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Both ends inclusive (P4); an end given as a date means its midnight
    (Q4). Pushed down to the scan when ``ts`` is a stored column."""
    c = F.col(ts)
    if start is not None:
        df = df.where(c >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(c <= F.lit(end).cast("timestamp_ntz"))
    return df


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement by a seeded random order (O6): a per-partition
    top-n, never a sort of the whole table."""
    return df.orderBy(F.rand(seed)).limit(n)


def keep_eligible(df: DataFrame, keys, min_rows: int = 50, required=()) -> DataFrame:
    """The rows of the series that :func:`eligible_series` accepts: a series with fewer
    complete rows is not fitted."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    good = eligible_series(df, keys, min_rows, required).where("eligible").select(*keys)
    return df.join(good, keys, "left_semi")


def eligible_series(df: DataFrame, keys, min_rows: int = 50,
                    required=(), target: str | None = None) -> DataFrame:
    """Per series: row count, rows complete in ``required`` columns, and the
    reason it is rejected, if any (P7). One grouped aggregate."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                F.count_if(complete).alias("n_complete"))
    reason = (F.when(F.col("n_complete") == 0, "no complete rows")
               .when(F.col("n_complete") < min_rows, f"fewer than {min_rows} complete rows"))
    return agg.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())
