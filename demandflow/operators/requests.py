"""The two requests of the analysis application as operators on any DataFrame: a forecast of
every series with one or more models, and a segmentation of all rows (M8, P7, S2-S4, E3-E6;
C3, C5, C9, C10, S6, S7). They compose the other operators and check their input."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.functions.scalars import iso_utc
from demandflow.operators import arima as AR
from demandflow.operators import clean as CL
from demandflow.operators import cluster as C
from demandflow.operators import features as FE
from demandflow.operators import metrics as M
from demandflow.operators import models as MO
from demandflow.operators import select as SE
from demandflow.operators import series as S
from demandflow.operators.profile import numeric_columns, string_columns

#: Names of the models in a request, by their estimator; the two others have no estimator.
MODELS = {"Linear": "linear", "RandomForest": "random_forest", "XGBoost": "xgboost", "ARIMA": None, "Naive": None}
#: Weather columns that a model or a segmentation uses where they exist.
WEATHER = ["precipIntensity", "precipProbability", "temperature", "apparentTemperature", "humidity", "windSpeed"]
CLUSTER_FEATURES = ["precipIntensity", "precipProbability", "temperature"]
#: Complete rows that a series needs.
MIN_ROWS = 50


def prepared(df: DataFrame, key: str, value: str | None = None, start=None, end=None, time: str | None = None,
             required: Sequence[str] = ()) -> DataFrame:
    """Checked and filtered rows with a parsed ``ts``: required columns must exist (S2), the time
    is ``time``, or the first of time, local_time, ts; text and unix seconds are parsed (L9). Rows of
    ``value`` in any case (an error if there are none), between ``start`` and ``end`` inclusive. Missing
    numbers become their column's mean over these rows, missing texts the mode (L2, L3)."""
    CL.require_columns(df, [key, *required])
    name = time or next((c for c in ("time", "local_time", "ts") if c in df.columns), None)
    if name is None:
        raise ValueError("no time column: time, local_time or ts")
    rows = CL.parse_time(df, name, "ts")
    if name != "ts":
        rows = rows.drop(name)
    rows = SE.filter_time(SE.filter_series(rows, key, value, check=value is not None), "ts", start, end)
    numbers = [c for c in numeric_columns(rows) if c != key]
    texts = [c for c in string_columns(rows) if c != key]
    rows = CL.impute_mean(rows, numbers) if numbers else rows
    return CL.impute_mode(rows, texts) if texts else rows


class Forecast:
    """A forecast request: features from ``lookback`` (lags 1, lookback and 7 lookback rows, rolling
    means and deviations over 6 and lookback rows, calendar), complete rows, the guard of at least
    ``min_rows`` rows a series, the chronological split, and every model named.

    ``metrics()`` has a row per series and model (errors, normalised errors, score, grade) and one
    per rejected series with its ``reason``; ``points()`` the actual and predicted values with ISO
    dates; ``features`` the model inputs used. Unknown models and missing columns are errors
    before any job; an empty result is no error."""

    def __init__(self, df: DataFrame, models: Sequence[str] = ("Linear",), key: str = "series", target: str = "demand",
                 value: str | None = None, start=None, end=None, time: str | None = None, lookback: int = 24,
                 min_rows: int = MIN_ROWS, train_frac: float = 0.8, **layout):
        unknown = [m for m in models if m not in MODELS]
        if unknown or not models:
            raise ValueError(f"invalid model names {unknown}; known are {sorted(MODELS)}")
        self.models, self.key, self.target, self.layout, self.train_frac = list(models), key, target, layout, train_frac
        self.naive = f"{target}_lag{lookback}"
        rows = prepared(df, key, value, start, end, time, [target])
        rows = FE.calendar_features(rows, "ts")
        if "hour" in rows.columns:
            rows = FE.cyclical_features(rows, {"hour": 24})
        wide = S.series_features(rows, [key], "ts", target, lags=[1, lookback, 7 * lookback], windows=[6, lookback], **layout)
        bound = S.series_max_rows(wide)
        wanted = [*WEATHER, "hour", "day_of_week", "month", f"{target}_lag1", self.naive, f"{target}_lag{7 * lookback}",
                  f"{target}_roll{lookback}_mean", "hour_sin", "hour_cos"]
        self.features = [c for c in dict.fromkeys(wanted) if c in wide.columns]
        complete = wide.dropna(how="any").persist()
        checked = SE.eligible_series(complete, key, min_rows)
        self.rejected = (rows.select(key).distinct().join(checked, key, "left").where(~F.coalesce("eligible", F.lit(False)))
                         .select(key, F.coalesce("reason", F.lit("no complete rows")).alias("reason")))
        good = SE.keep_eligible(complete, key, min_rows)
        self.rows = S.chrono_split(good, [key], "ts", train_frac=train_frac, max_rows=bound, **layout)
        self._predicted: DataFrame | None = None

    def predictions(self) -> DataFrame:
        """(key, ts, model, actual, predicted) of every test row and model."""
        if self._predicted is None:
            y = F.col(self.target).alias("actual")
            frames, data = [], None
            for name in self.models:
                label = F.lit(name).alias("model")
                if name == "Naive":
                    one = self.rows.where("split = 'test'").select(self.key, "ts", label, y, F.col(self.naive).alias("predicted"))
                elif name == "ARIMA":
                    given = self.rows.select(self.key, "ts", self.target)
                    params = AR.fit_arima(given, self.key, "ts", self.target, self.train_frac, **self.layout)
                    fc = AR.arima_forecast(given, self.key, "ts", self.target, params, self.train_frac, **self.layout)
                    one = fc.select(self.key, "ts", label, "actual", F.col("forecast").alias("predicted"))
                else:
                    data = data if data is not None else MO.compact(MO.design(self.rows, self.features))
                    if data.where("split = 'train'").isEmpty():
                        continue
                    fitted = MO.fit_predict(data, MODELS[name], self.target)[1]
                    one = fitted.where("split = 'test'").select(self.key, "ts", label, y, "predicted")
                frames.append(one)
            none = self.rows.where("false").select(self.key, "ts", F.lit("").alias("model"), y, F.lit(0.0).alias("predicted"))
            self._predicted = reduce(DataFrame.unionByName, frames, none)
        return self._predicted

    def points(self) -> DataFrame:
        """(key, model, date, actual, predicted) with ISO dates."""
        return self.predictions().select(self.key, "model", iso_utc("ts").alias("date"), "actual", "predicted")

    def metrics(self) -> DataFrame:
        """Errors, normalised errors, score, grade and rank per series and model (E1, E3, E4); a
        row with ``reason`` per rejected series."""
        m = M.regression_metrics(self.predictions(), [self.key, "model"])
        m = M.rank_models(M.performance_score(M.normalized_metrics(m)), [self.key])
        return m.withColumn("reason", F.lit(None).cast("string")).unionByName(self.rejected, allowMissingColumns=True)


class Segments:
    """A segmentation request: the weather features that exist (apparentTemperature instead of
    temperature), imputed and standardised; K-Means with ``k`` centres, or the k of the best
    silhouette where ``k`` is None; two principal components for the picture.

    ``points()`` has the rows' components and label; ``centres`` a row per cluster in original
    units; ``silhouette`` is -1 with fewer than two labels or not more rows than ``k``; ``scores`` the
    silhouette and inertia per k where k was chosen. Without features it is an error; an empty
    table has no points and no centres."""

    def __init__(self, df: DataFrame, k: int | None = 3, features: Sequence[str] = CLUSTER_FEATURES, keep: Sequence[str] = (),
                 ks: Sequence[int] = range(2, 11), seed: int = 42, n_init: int = 10):
        self.features = CL.resolve_features(df, features)
        if not self.features:
            raise ValueError(f"none of the features {list(features)}")
        spark, cols = df.sparkSession, self.features
        self.scores = None
        if k is None:
            self.scores = C.select_k(df, cols, ks, seed, n_init).persist()
            best = self.scores.where("best").select("k").first()
            k = best.k if best else 1
        self.k = k
        vec = C.cached_vectors(df, cols)
        n = vec.count()
        self._model = C.kmeans_best(vec, k, seed, n_init) if n else None
        self.silhouette = -1.0
        if n:
            rows = self._model.transform(vec).select(F.lit(0).alias("run"), F.col("cluster").alias("label"), vector_to_array(C.VEC).alias("x"))
            found = C.label_silhouettes(rows, len(cols)).first() if n > k else None     # no row: one label
            self.silhouette = float(found.silhouette) if found else -1.0
        fields = "cluster int, " + ", ".join(f"`{c}` double" for c in cols)
        rows = [(i, *map(float, c)) for i, c in enumerate(self._model.clusterCenters())] if n else []
        self.centres = FE.unstandardize(spark.createDataFrame(rows, fields), cols, FE.scaler_stats(CL.impute_mean(df, cols), cols))
        vec.unpersist()
        self._df, self._keep, self._n = df, list(keep), n

    def points(self) -> DataFrame:
        """(keep..., PC1, PC2, label): one row per row of the table."""
        if not self._n:
            return self._df.select(*self._keep, *[F.lit(None).cast("double").alias(c) for c in ("PC1", "PC2")], F.lit(0).alias("label"))
        labelled = self._model.transform(C.scaled_vectors(self._df, self.features))
        return C.pca_columns(labelled, self.features, k=min(2, len(self.features))).withColumnRenamed("cluster", "label").select(
            *self._keep, "PC1", *(["PC2"] if len(self.features) > 1 else [F.lit(0.0).alias("PC2")]), "label")

    def score_lines(self) -> DataFrame:
        """The score report (S6) as numbered text lines: the features, one line per k, the best k."""
        if self.scores is None:
            raise ValueError("the scores of several k are made where k is None")
        # The wording of the report
        head, each = f"Feature subset: {self.features}", "K = %d: %.4f"
        best, top = "Best number of clusters based on silhouette score: %d", "Best silhouette score: %.4f"
        rows = self.scores.where("silhouette IS NOT NULL")
        lines = rows.select((F.col("k") + 10).alias("line_no"), F.format_string(each, "k", "silhouette").alias("line"))
        last = rows.where("best").select(F.explode(F.array(
            F.struct(F.lit(1_000_000).alias("line_no"), F.format_string(best, "k").alias("line")),
            F.struct(F.lit(1_000_001).alias("line_no"), F.format_string(top, "silhouette").alias("line")))).alias("r")).select("r.*")
        first = self._df.sparkSession.createDataFrame([(1, head), (2, "Silhouette Scores for Different K Values:")], "line_no int, line string")
        return first.unionByName(lines).unionByName(last)
