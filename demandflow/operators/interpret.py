"""Cluster interpretation.

Everything starts from grouped aggregates over the labelled rows (map-side
partial aggregation, one shuffle keyed by label or (label, value)); the
windows afterwards run over those aggregates, whose size is the number of
clusters times features or category values, never the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandflow.functions import scalars as X
from demandflow.operators.quantiles import quantile_wide


def cluster_means(df: DataFrame, label: str, features: Sequence[str],
                  exclude_noise: bool = False) -> DataFrame:
    """Mean of each feature per cluster (A2, D3); DBSCAN noise (-1) can be
    left out."""
    src = df.where(F.col(label) != -1) if exclude_noise else df
    return src.groupBy(label).agg(*[F.avg(c).alias(c) for c in features])


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per cluster and share of all rows in percent (A3)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("size")).persist()
    total = counts.agg(F.sum("size")).first()[0] or 0      # one number from k rows
    return counts.withColumn("pct", F.col("size") / F.lit(total) * 100)


def value_shares(df: DataFrame, label: str, col: str) -> DataFrame:
    """Long (label, value, count, share): ``value_counts(normalize=True)``
    per cluster (A4, long form)."""
    counts = df.groupBy(label, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(label)))


def category_distribution(df: DataFrame, label: str, col: str,
                          values: Sequence | None = None) -> DataFrame:
    """Wide share table: one row per cluster, one column per category,
    missing combinations 0 (A4, ``unstack().fillna(0)``). Pass ``values``
    to avoid the extra job that discovers them."""
    shares = value_shares(df, label, col)
    piv = shares.groupBy(label).pivot("value", list(values) if values is not None else None)
    return piv.agg(F.first("share")).fillna(0.0)


def top_n_per_group(df: DataFrame, label: str, col: str, n: int = 3) -> DataFrame:
    """The ``n`` most frequent values per cluster with their share; ties by
    smaller value (W7, ``value_counts(normalize=True).nlargest(n)``)."""
    shares = value_shares(df, label, col)
    w = Window.partitionBy(label).orderBy(F.col("count").desc(), F.col("value"))
    return shares.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _long_means(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    return (cluster_means(df, label, features)
            .unpivot([label], list(features), "feature", "mean"))


def cluster_vs_overall(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Per cluster and feature: cluster mean, min, max next to the dataset
    mean (A7). The dataset means are one row, broadcast."""
    aggs = []
    for c in features:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    per = df.groupBy(label).agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("cluster_mean"),
                                 F.col(f"{c}__min").cast("double").alias("cluster_min"),
                                 F.col(f"{c}__max").cast("double").alias("cluster_max"))
                        for c in features])
    long = per.select(label, F.inline(entries))
    overall = (df.agg(*[F.avg(c).alias(c) for c in features])
                 .unpivot([], list(features), "feature", "dataset_mean"))
    return long.join(F.broadcast(overall), "feature")     # one row per feature


def cluster_box_stats(df: DataFrame, label: str, col: str) -> DataFrame:
    """Five-number summary of ``col`` per cluster (A8): exact quantiles."""
    q = quantile_wide(df, [col], (0.0, 0.25, 0.5, 0.75, 1.0), [label],
                      names=["min", "q1", "median", "q3", "max"])
    return q.drop("column")


def cluster_zscores(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Cluster means standardised across clusters per feature (sample std);
    a feature equal in every cluster gives null (W8, Q22)."""
    m = _long_means(df, label, features)
    w = Window.partitionBy("feature")
    z = F.try_divide(F.col("mean") - F.avg("mean").over(w), F.stddev_samp("mean").over(w))
    return m.withColumn("z", z)


def cluster_minmax(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Cluster means scaled to 0..1 across clusters per feature; range 0
    scales by 1 (W9, radar data)."""
    m = _long_means(df, label, features)
    w = Window.partitionBy("feature")
    lo, hi = F.min("mean").over(w), F.max("mean").over(w)
    rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    return m.withColumn("scaled", (F.col("mean") - lo) / rng)


def _pct_text(share) -> F.Column:
    return F.format_string("%.1f%%", share * 100)


def _joined_top(df, label, col, n, fmt_value) -> DataFrame:
    top = top_n_per_group(df, label, col, n)
    item = F.concat(fmt_value(F.col("value")), F.lit(" ("), _pct_text(F.col("share")), F.lit(")"))
    # collect at most n small strings per cluster, in rank order
    return (top.groupBy(label)
               .agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))).alias("_l"))
               .select(label, F.array_join(F.transform("_l", lambda s: s["t"]), ", ").alias("txt")))


def describe_clusters(df: DataFrame, label: str, features: Sequence[str],
                      hour: str | None = "hour", dow: str | None = "day_of_week",
                      target: str | None = "demand", season: str | None = None) -> DataFrame:
    """One row per cluster: size, share, feature means next to the dataset
    means, common hours and days, seasons, mean and range of the target (D1).
    Sizes, means and ranges are one aggregate; the dataset's follow from it."""
    cols = [*features, *([target] if target else [])]
    base = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("size"),
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.sum(c).alias(f"_s_{c}") for c in cols],
        *[F.count(c).alias(f"_n_{c}") for c in cols],
        *([F.min(target).alias("_t_min"), F.max(target).alias("_t_max")] if target else [])).persist()
    all_ = base.agg(F.sum("size").alias("size"), *[(F.sum(f"_s_{c}") / F.sum(f"_n_{c}")).alias(c) for c in cols]).first()
    mean = lambda c: F.lit(all_[c]).cast("double")
    parts = [F.format_string("%s: %.2f (Dataset Mean: %.2f)", F.lit(c), F.col(f"_m_{c}"), mean(c)) for c in features]
    out = base.withColumn("pct", F.col("size") / F.lit(all_["size"] or 0) * 100).withColumn("features", F.concat_ws("; ", *parts))
    tops = [(hour, 3, "common_hours", lambda v: F.concat(v.cast("string"), F.lit(":00"))),
            (dow, 3, "common_days", X.day_name), (season, 2, "seasons", lambda v: v)]
    for col, n, name, text in tops:
        if col:
            out = out.join(_joined_top(df, label, col, n, text).withColumnRenamed("txt", name), label, "left")
    if target:
        out = out.withColumn("target_text", F.format_string(
            "Average: %.2f (Dataset Mean: %.2f); range %.2f - %.2f",
            F.col(f"_m_{target}"), mean(target), F.col("_t_min"), F.col("_t_max")))
    head = F.format_string("Cluster %s (%d points, %.1f%% of data)", F.col(label).cast("string"),
                           F.col("size"), F.col("pct"))
    keep = [c for c in ("features", "common_hours", "common_days", "seasons", "target_text") if c in out.columns]
    return out.select(label, "size", "pct", head.alias("header"), *keep, *[f"_m_{c}" for c in cols])


def report_text(df: DataFrame, label: str, features: Sequence[str], hour: str = "hour",
                season: str = "season", target: str = "demand") -> DataFrame:
    """The text report (S6): label, line_no, line. The wording of the lines."""
    d = describe_clusters(df, label, features, hour, None, target, season)
    lines = [F.concat("header", F.lit(":")),
             *[F.format_string("  %s: %.4f", F.lit(c), F.col(f"_m_{c}")) for c in features],
             F.concat(F.lit("  Common hours: "), F.col("common_hours")), F.concat(F.lit("  Seasons: "), F.col("seasons")),
             F.format_string("  Average demand: %.2f", F.col(f"_m_{target}"))]
    return d.select(label, F.posexplode(F.array(*lines)).alias("line_no", "line"))


def cluster_profiles(df: DataFrame, label: str, features: Sequence[str],
                     categorical: Sequence[str] = (), top: int = 3,
                     dominance: float = 0.4) -> DataFrame:
    """'Cluster c: f1 (high), f2 (low), ...' from the ``top`` largest |z|
    (ties by feature name, null z last and called low), plus
    ', mostly during col=value (p%)' when a category holds more than
    ``dominance`` of the cluster (D2)."""
    z = cluster_zscores(df, label, features)
    w = Window.partitionBy(label).orderBy(F.abs("z").desc_nulls_last(), F.col("feature"))
    picked = (z.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
               .withColumn("t", F.concat(F.col("feature"), F.lit(" ("),
                                         F.when(F.col("z") > 0, "high").otherwise("low"), F.lit(")"))))
    prof = (picked.groupBy(label)
                  .agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("_l"))
                  .select(label, F.array_join(F.transform("_l", lambda s: s["t"]), ", ").alias("p")))
    extra = []
    for c in categorical:
        dom = (top_n_per_group(df, label, c, 1).where(F.col("share") > dominance)
               .select(label, F.format_string(", mostly during %s=%s (%s)", F.lit(c),
                                              F.col("value").cast("string"),
                                              _pct_text(F.col("share"))).alias(f"_d_{c}")))
        prof = prof.join(dom, label, "left")
        extra.append(F.coalesce(F.col(f"_d_{c}"), F.lit("")))
    text = F.concat(F.lit("Cluster "), F.col(label).cast("string"), F.lit(": "), F.col("p"), *extra)
    return prof.select(label, text.alias("profile"))


def records_json(df: DataFrame, cols: Sequence[str], name: str = "record") -> DataFrame:
    """Each row as one JSON object of the given columns (S7, F17): records
    are written row by row (``write.text``), never gathered into one value."""
    return df.select(F.to_json(F.struct(*cols)).alias(name))
