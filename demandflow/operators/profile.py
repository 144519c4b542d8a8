"""Table profiling (R1-R7, A5, A6): schema and null counts, duplicates,
summary statistics, correlations.

Each profile is one or two aggregation passes with map-side partial
aggregation; results are long tables (one row per column or column pair),
so their size depends on the column count, never on the row count.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandflow.operators.quantiles import quantile_wide

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of a numeric type (R7, ``select_dtypes('number')``)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def column_info(df: DataFrame) -> DataFrame:
    """Per column: position, type, non-null and null counts, row count (R2)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(f"`{c}`")).alias(f"_nn{i}") for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                                 F.col(f"_nn{i}").alias("non_null"))
                        for i, c in enumerate(cols)])
    return (row.select(F.col("_rows").alias("n_rows"), F.inline(entries))
               .withColumn("null_count", F.col("n_rows") - F.col("non_null"))
               .select("position", "column", "dtype", "non_null", "null_count", "n_rows"))


def null_counts(df: DataFrame, only_positive: bool = False) -> DataFrame:
    """Null count per column (R4); NaN in floating columns counts as null."""
    exprs = []
    for c in df.columns:
        isnull = F.col(f"`{c}`").isNull()
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            isnull = isnull | F.isnan(F.col(f"`{c}`"))
        exprs.append(F.struct(F.lit(c).alias("column"),
                              F.sum(isnull.cast("long")).alias("null_count")))
    out = df.agg(F.array(*exprs).alias("_a")).select(F.inline("_a"))
    return out.where(F.col("null_count") > 0) if only_positive else out


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (R5, ``duplicated().sum()``).

    One grouping over all columns (nulls compare equal, as in pandas), with
    partial aggregation before the shuffle; a key holding many copies
    collapses map-side to one row per task.
    """
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"),
                      F.count(F.lit(1)).alias("n_distinct"),
                      F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_duplicates"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = (),
             probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std (sample), min, quartiles (exact, linear), max per
    column and group (R3). Long form: keys..., column, statistics."""
    keys = list(keys)
    cols = list(cols or numeric_columns(df, exclude=keys))
    # NaN is a missing value; a column without values keeps its row (count 0)
    long = (df.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
              .unpivot(keys, cols, "column", "x"))
    moments = long.groupBy(*keys, "column").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    names = [f"p{int(round(p * 100))}" for p in probs]
    q = quantile_wide(df, cols, probs, keys, names=names, long=long.where(F.col("x").isNotNull()))
    return (moments.join(q, [*keys, "column"], "left")
                   .select(*keys, "column", "count", "mean", "std", "min", *names, "max"))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered column pair, pairwise-complete
    (R6). One aggregation pass; result has len(cols)^2 rows."""
    cols = list(cols or numeric_columns(df))
    pairs = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                      F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr"))
             for a, b in product(cols, cols)]
    return df.agg(F.array(*pairs).alias("_a")).select(F.inline("_a"))


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by an explicit order (R1); a top-k, never a sort of
    the whole table."""
    return df.orderBy(*order).limit(n)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values, sorted."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
