"""Forecast evaluation (E1-E6), model comparison (U1, O2-O4), alignment.

Every metric is one grouped aggregate (partial aggregation map-side, one
small shuffle), so evaluating many series and models costs one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandflow.functions.scalars import iso_utc, performance_grade


def _keys(k):
    return [k] if isinstance(k, str) else list(k or [])


def regression_metrics(df: DataFrame, keys=(), actual="actual", predicted="predicted") -> DataFrame:
    """MAE, RMSE, R^2 and MAPE per group.

    R^2 = 1 - SS_res / SS_tot; a constant actual gives 1 when predictions are
    exact and 0 otherwise. MAPE skips zero actuals and is null when none is
    left (Q6).
    """
    keys = _keys(keys)
    y, p = F.col(actual), F.col(predicted)
    e = p - y
    rows = df.where(y.isNotNull() & p.isNotNull())
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_ss_res"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_ss_tot"),
        (F.avg(F.abs(e) / F.nullif(F.abs(y), F.lit(0.0))) * 100).alias("mape"),
        F.avg(y).alias("mean_actual"),
    )
    r2 = (F.when(F.col("_ss_tot") == 0, F.when(F.col("_ss_res") == 0, 1.0).otherwise(0.0))
           .otherwise(1 - F.col("_ss_res") / F.col("_ss_tot")))
    return m.withColumn("r2", r2).drop("_ss_res", "_ss_tot")


def improvement_over_baseline(metrics: DataFrame, baseline: DataFrame, keys=(),
                              cols=("mae", "rmse", "mape")) -> DataFrame:
    """Percent improvement (base - m) / base * 100 against a baseline row per
    group (E2). The baseline side has one row per group."""
    keys = _keys(keys)
    b = baseline.select(*keys, *[F.col(c).alias(f"_base_{c}") for c in cols])
    if keys:
        out = metrics.join(b, keys, "left")
    else:                                   # one baseline row: its values as literals
        row = b.first().asDict()
        out = metrics.withColumns({k: F.lit(v).cast("double") for k, v in row.items()})
    for c in cols:
        out = out.withColumn(f"{c}_improvement",
                             (F.col(f"_base_{c}") - F.col(c))
                             / F.nullif(F.col(f"_base_{c}"), F.lit(0.0)) * 100)
    return out.drop(*[f"_base_{c}" for c in cols])


def normalized_metrics(metrics: DataFrame) -> DataFrame:
    """Map MAE, RMSE, R^2, MAPE to 0..1, 1 best (E3). Needs ``mean_actual``."""
    mean_y = F.col("mean_actual")
    return metrics.withColumns({
        "mae_norm": 1 - F.least(F.lit(1.0), F.try_divide(F.col("mae"), mean_y * 0.3)),
        "rmse_norm": 1 - F.least(F.lit(1.0), F.try_divide(F.col("rmse"), mean_y * 0.4)),
        "r2_norm": F.when(F.col("r2") < 0, (F.col("r2") + 1) / 2).otherwise(F.col("r2")),
        "mape_norm": F.when(F.col("mape").isNull(), 0.5)
                      .otherwise(1 - F.least(F.lit(1.0), F.col("mape") / 100)),
    })


def performance_score(normalized: DataFrame) -> DataFrame:
    """Weighted score .3/.3/.3/.1 and its grade."""
    score = (F.col("mae_norm") * 0.3 + F.col("rmse_norm") * 0.3
             + F.col("r2_norm") * 0.3 + F.col("mape_norm") * 0.1)
    return (normalized.withColumn("performance_score", score)
                      .withColumn("performance_grade", performance_grade("performance_score")))


def model_comparison(frames: list[DataFrame]) -> DataFrame:
    """Union of per-model metric rows (U1); columns missing in one are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rank_models(comparison: DataFrame, keys=(), metric="mae", name="model") -> DataFrame:
    """Rank per group by ``metric`` ascending, ties by model name (O2)."""
    w = Window.partitionBy(*_keys(keys)).orderBy(F.col(metric).asc_nulls_last(), F.col(name))
    return comparison.withColumn("rank", F.row_number().over(w))


def top_models(comparison: DataFrame, k=3, keys=(), metric="mae", name="model",
               exclude=("naive",)) -> DataFrame:
    """Best ``k`` models by ``metric`` per group, excluding some names (O3)."""
    c = comparison.where(~F.col(name).isin(*exclude)) if exclude else comparison
    return rank_models(c, keys, metric, name).where(F.col("rank") <= k)


def best_model(comparison: DataFrame, keys=(), metric="mae", name="model") -> DataFrame:
    """One row per group: the model with the lowest ``metric``."""
    keys = _keys(keys)
    order = F.struct(F.col(metric), F.col(name))
    best = comparison.where(F.col(metric).isNotNull()).groupBy(*keys).agg(
        F.min_by(F.col(name), order).alias("best_model"),
        F.min(metric).alias(f"best_{metric}"))
    return best


def forecast_points(pred: DataFrame, keys, ts="ts", actual="actual", predicted="predicted") -> DataFrame:
    """Actual vs predicted rows with ISO dates."""
    return pred.select(*_keys(keys), iso_utc(ts).alias("date"),
                       F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))


def align_predictions(actuals: DataFrame, preds: DataFrame, on) -> DataFrame:
    """Left join of predictions onto actuals by key and time."""
    return actuals.join(preds, _keys(on), "left")
