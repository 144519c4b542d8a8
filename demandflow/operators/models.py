"""Forecasting models on a pooled feature table.

One model is fitted over the train rows of all series together, as the
reference fits one model over its whole table; Spark ML distributes each
fit (normal equations through a d x d aggregate, trees through per-
partition histograms). The train/test split is per series and
chronological, so no test row reaches a fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.operators import features as FE
from demandflow.operators import metrics as M
from demandflow.operators import series as S
from demandflow.operators.cluster import assemble

VEC = "_x"

# Model inputs of the reference's batch forecast (lag and
# rolling names use the target "demand").
MODEL_FEATURES = ["precipIntensity", "precipProbability", "temperature", "hour", "day_of_week",
                  "month", "demand_lag1", "demand_lag24", "demand_lag168", "demand_roll24_mean",
                  "hour_sin", "hour_cos"]


def feature_table(df: DataFrame, keys="series", ts="ts", target="demand",
                  lags=(1, 24, 168), windows=(6, 12, 24), train_frac=0.8, **layout) -> DataFrame:
    """Calendar + cyclical + lag + rolling features, rows with a null in any
    column dropped (Q17), then the per-series chronological split."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = FE.calendar_features(df, ts)
    out = FE.cyclical_features(out)
    out = S.series_features(out, keys, ts, target, lags=lags, windows=windows, **layout)
    bound = S.series_max_rows(out)              # dropping rows keeps series within it
    return S.chrono_split(out.dropna(how="any"), keys, ts, train_frac=train_frac,
                          max_rows=bound, **layout)


def design(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale features with train-only statistics (population std) and
    assemble them; the target is left unscaled."""
    feats = [f for f in features if f in table.columns]
    stats = FE.scaler_stats(table.where(F.col("split") == "train"), feats)
    scaled = FE.standardize(table, feats, stats, suffix="__z")
    return assemble(scaled, [f"{f}__z" for f in feats], VEC).drop(*[f"{f}__z" for f in feats])


ROWS_PER_PARTITION = 100_000


def compact(data: DataFrame) -> DataFrame:
    """``data`` cached with as many partitions as its counted rows need: tree fits run hundreds
    of short jobs, which pay for every task. Merging needs no shuffle."""
    held = data.persist()
    want = max(1, -(-held.count() // ROWS_PER_PARTITION))
    if want >= held.rdd.getNumPartitions():
        return held
    small = held.coalesce(want).persist()
    small.count()
    held.unpersist()
    return small


def make_estimator(name: str, target: str = "demand", n_train: int | None = None,
                   y_std: float | None = None, alpha: float = 1.0, seed: int = 42):
    """Estimator by model name (M8); unknown names raise ``ValueError``."""
    common = dict(featuresCol=VEC, labelCol=target, predictionCol="predicted")
    if name == "linear":
        return LinearRegression(solver="normal", regParam=0.0, **common)
    if name == "ridge":
        # sklearn Ridge(alpha) objective |y - Xw|^2 + alpha |w|^2, expressed in
        # Spark's label-scaled parameterisation (rule N8)
        reg = alpha * (y_std or 1.0) / max(n_train or 1, 1)
        return LinearRegression(solver="normal", regParam=reg, elasticNetParam=0.0,
                                standardization=False, **common)
    if name == "random_forest":
        # maxMemoryInMB bounds the per-task histogram buffer (how many nodes
        # are split per pass), not the model: small enough that every task
        # slot of an executor can hold one
        return RandomForestRegressor(numTrees=100, maxDepth=10, featureSubsetStrategy="all",
                                     seed=seed, maxMemoryInMB=16, **common)
    if name in ("gbt", "xgboost"):
        # no xgboost here: gradient-boosted trees with the same shape (M5)
        return GBTRegressor(maxIter=100, maxDepth=5, stepSize=0.1, seed=seed, maxMemoryInMB=16,
                            **common)
    raise ValueError(f"unknown model {name!r}")


def fit_predict(data: DataFrame, name: str, target: str = "demand", **kw):
    """Fit on the train rows, predict every row; returns (model, rows)."""
    train = data.where(F.col("split") == "train")
    if name == "ridge":
        st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
        kw = dict(kw, n_train=st["n"], y_std=st["s"])
    model = make_estimator(name, target, **kw).fit(train)
    return model, model.transform(data)


def evaluate(pred: DataFrame, name: str, keys=("series",), target: str = "demand",
             baseline: str = "demand_lag24") -> DataFrame:
    """Metrics on the test rows per group of ``keys``, with improvement over
    the seasonal-naive forecast on the same rows (M10, E1, E2)."""
    keys = list(keys)
    test = pred.where(F.col("split") == "test")
    m = M.regression_metrics(test, keys, target, "predicted").withColumn("model", F.lit(name))
    b = M.regression_metrics(test, keys, target, baseline)
    return M.improvement_over_baseline(m, b, keys)


def feature_importance(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance) sorted descending (M9); tree models only."""
    imp = model.featureImportances.toArray()
    return sorted(zip(features, [float(x) for x in imp]), key=lambda t: (-t[1], t[0]))


# --- linear fits from sums (M1, M2, M6) ---------------------------------------------------

class Gram:
    """Sums of the products of all features and the target, in one number array per group: a
    least-squares or ridge fit needs nothing else, and sums of groups add and subtract."""

    def __init__(self, n: float, x: np.ndarray, y: float, xx: np.ndarray, xy: np.ndarray):
        self.n, self.x, self.y, self.xx, self.xy = n, x, y, xx, xy

    def __add__(self, o: "Gram") -> "Gram":
        return Gram(self.n + o.n, self.x + o.x, self.y + o.y, self.xx + o.xx, self.xy + o.xy)

    def __sub__(self, o: "Gram") -> "Gram":
        return Gram(self.n - o.n, self.x - o.x, self.y - o.y, self.xx - o.xx, self.xy - o.xy)

    def solve(self, alpha: float = 0.0) -> tuple[np.ndarray, float]:
        """Coefficients and intercept of |y - Xw - b|^2 + alpha |w|^2 (least norm if singular)."""
        if self.n < 1:
            return np.zeros(len(self.x)), 0.0
        mx, my = self.x / self.n, self.y / self.n
        a = self.xx - self.n * np.outer(mx, mx) + alpha * np.eye(len(mx))
        w = np.linalg.lstsq(a, self.xy - self.n * mx * my, rcond=1e-12)[0]
        return w, float(my - w @ mx)


def gram_by(df: DataFrame, features: Sequence, target: str, group: str | None = None) -> dict:
    """group value -> :class:`Gram` over the columns ``features`` (names or expressions): one
    aggregate, one row per group. ``group`` must have few values (folds)."""
    x = [F.col(f) if isinstance(f, str) else f for f in features]
    d, y = len(x), F.col(target)
    named = df.select(*([group] if group else []), y.cast("double").alias("_y"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)])
    v = [F.col(f"_x{i}") for i in range(d)]
    sums = [F.count(F.lit(1)), F.sum("_y"), *[F.sum(c) for c in v], *[F.sum(c * F.col("_y")) for c in v],
            *[F.sum(v[i] * v[j]) for i in range(d) for j in range(i, d)]]
    out = {}
    for r in named.groupBy(*([group] if group else [])).agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).collect():
        key, s = (r[0], r[1:]) if group else (None, tuple(r))
        s = np.array([0.0 if q is None else q for q in s])
        xx = np.zeros((d, d))
        xx[np.triu_indices(d)] = s[2 + 2 * d:]
        out[key] = Gram(s[0], s[2:2 + d], s[1], xx + np.triu(xx, 1).T, s[2 + d:2 + 2 * d])
    return out


def linear_column(features: Sequence, w: np.ndarray, b: float):
    """The fitted line as an expression."""
    x = [F.col(f) if isinstance(f, str) else f for f in features]
    return reduce(add, [c * F.lit(float(q)) for c, q in zip(x, w)], F.lit(float(b)))


ALPHAS = {"linear": 0.0, "ridge": 1.0}


def out_of_fold(train: DataFrame, features: Sequence, target: str, alpha: float = 0.0, fold: str = "fold",
                out: str = "predicted") -> DataFrame:
    """``train`` with the prediction of a linear model fitted on the other folds: the sums of all
    rows less those of the fold, from one aggregate."""
    sums = gram_by(train, features, target, fold)
    if not sums:
        return train.withColumn(out, F.lit(None).cast("double"))
    total = reduce(add, sums.values())
    column = F.lit(None).cast("double")
    for k, own in sums.items():
        column = F.when(F.col(fold) == k, linear_column(features, *(total - own).solve(alpha))).otherwise(column)
    return train.withColumn(out, column)


def stacking(data: DataFrame, bases: Sequence[str], keys=("series",), ts: str = "ts",
             target: str = "demand", n_folds: int = 5, alpha: float = 1.0,
             parallelism: int = 8, fitted: dict | None = None, **layout) -> DataFrame:
    """Stacked regression (M6): out-of-fold predictions of each base model
    over contiguous folds of the train rows (per series, as an unshuffled
    K-fold), a ridge model on those, bases refit on all train rows (``fitted``
    models by name are taken as they are). Linear bases and the final model
    come from sums; tree fits run as concurrent jobs.
    Returns ``data`` with ``predicted``."""
    keys, bases = list(keys), list(bases)
    # the fold is a column of the rows themselves and every base adds a column of
    # predictions: nothing is joined, so rows with tied times stay single
    train = compact(S.stacking_folds(data.where(F.col("split") == "train"), keys, ts, n_folds, **layout))
    d = train.select(F.size(vector_to_array(VEC)).alias("d")).first()
    x = [vector_to_array(VEC)[i] for i in range(d.d if d else 0)]
    linear = [b for b in bases if b in ALPHAS]
    trees = [b for b in bases if b not in ALPHAS]
    models = dict(fitted or {})

    def fit_one(job):
        # one base model without fold f, or on all train rows (f is None)
        b, f = job
        rows = train if f is None else train.where(F.col("fold") != f)
        return make_estimator(b, target).fit(rows)

    jobs = [(b, f) for b in trees for f in [*range(n_folds), None] if f is not None or b not in models]
    if jobs and not train.isEmpty():
        with ThreadPoolExecutor(max_workers=parallelism) as pool:   # independent fits, concurrent jobs
            done = dict(zip(jobs, pool.map(fit_one, jobs)))
    else:
        done, trees, linear = {}, [], bases if not trees else []
    oof = train
    for b in linear:
        oof = out_of_fold(oof, x, target, ALPHAS[b], out=b)
    parts = []
    for f in range(n_folds) if trees else ():
        rows = oof.where(F.col("fold") == f)
        for b in trees:
            rows = done[b, f].transform(rows).withColumnRenamed("predicted", b)
        parts.append(rows.select(target, *bases))
    meta_in = reduce(DataFrame.unionByName, parts) if parts else oof.select(target, *(linear or [F.lit(0.0).alias(b) for b in bases]))
    whole = gram_by(train, x, target).get(None) if linear else None
    meta = gram_by(meta_in, bases, target).get(None)
    preds = data
    for b in bases:
        if b in ALPHAS:
            preds = preds.withColumn(b, linear_column(x, *whole.solve(ALPHAS[b])) if whole else F.lit(0.0))
        elif (b, None) in done or b in models:
            preds = (done.get((b, None)) or models[b]).transform(preds).withColumnRenamed("predicted", b)
        else:
            preds = preds.withColumn(b, F.lit(0.0))
    out = preds.withColumn("predicted", linear_column(bases, *meta.solve(alpha)))
    train.unpersist()
    return out
