"""Sources and sinks with temporary folders."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from demandflow.operators import clean as C
from demandflow.sources import io as IO


def _tmp():
    return tempfile.mkdtemp(prefix="demandflow-test-")


def test_csv_roundtrip_and_required_columns(spark):
    path = os.path.join(_tmp(), "data.csv")
    with open(path, "w") as f:
        f.write("time,demand,apparentTemperature,region\n")
        f.write("2018-01-01 00:00:00,10.5,3.0,A\n2018-01-01 01:00:00,,4.0,\n")
    df = IO.read_table(spark, path)
    assert dict(df.dtypes)["demand"] == "double"
    assert df.where(F.col("demand").isNull()).count() == 1
    C.require_columns(df, ["demand", "temperature"], {"temperature": "apparentTemperature"})
    out = os.path.join(_tmp(), "out_csv")
    IO.write_table(C.resolve_columns(df), out, fmt="csv")
    back = IO.read_table(spark, out, fmt="csv")
    assert "temperature" in back.columns and back.count() == 2


def test_parquet_partitioned_and_text_json_sinks(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "series string, v double")
    out = os.path.join(_tmp(), "pq")
    IO.write_table(df, out, partition_by=["series"])
    assert {"series=a", "series=b"} <= set(os.listdir(out))
    assert IO.read_table(spark, out).where("series = 'b'").first()["v"] == 2.0
    lines = os.path.join(_tmp(), "txt")
    IO.write_lines(df.select(F.format_string("%s: %.2f", "series", "v")), lines)
    text = "".join(open(os.path.join(lines, f)).read() for f in os.listdir(lines) if f.startswith("part"))
    assert sorted(text.split()) == sorted(["a:", "1.00", "b:", "2.00"])
    js = os.path.join(_tmp(), "json")
    IO.write_json_records(df, js)
    recs = [json.loads(x) for f in os.listdir(js) if f.startswith("part") for x in open(os.path.join(js, f))]
    assert sorted(r["series"] for r in recs) == ["a", "b"]
