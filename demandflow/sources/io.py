"""Sources and sinks.

Reading is lazy and columnar: with parquet, Catalyst prunes columns and
pushes filters into the scan; CSV is read with an explicit schema when one
is known (no extra inference pass over the data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, header: bool = True,
               nan_value: str = "NaN") -> DataFrame:
    """Read CSV (header, inferred or given types) or parquet (S1). The
    format follows the file extension unless given."""
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", header).option("nanValue", nan_value)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    # an empty numeric field is missing in both engines: null here
    return reader.csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write a table (S5): CSV with a header and no index column, or
    parquet, optionally partitioned (e.g. by series) for pruning later."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_lines(lines: DataFrame, path: str, col: str | None = None, mode: str = "overwrite") -> None:
    """Text report sink (S6): one line per row, written by the executors."""
    i = lines.columns.index(col) if col else 0
    named = lines.toDF(*[f"_c{j}" for j in range(len(lines.columns))])   # any column name
    named.select(F.col(f"_c{i}").cast("string").alias("value")).write.mode(mode).text(path)


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON records sink (S7): one JSON object per row (JSON lines)."""
    df.write.mode(mode).json(path)
