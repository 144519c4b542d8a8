"""ARIMA(1,1,1) without constant, one model per series (M7).

Model on the differences d_t = y_t - y_{t-1}:
    d_t = phi * d_{t-1} + e_t + theta * e_{t-1}
Fitting is conditional least squares (e and d before the first row are 0) on
all train rows of the series, by a grid of (phi, theta) pairs refined around
the best. No task holds a whole series: inside a chunk of consecutive rows the
residual is affine in the residual that comes in, e = u + v * e_in, so a chunk
returns per pair the outgoing u and v and the sums of u*u, u*v and v*v. Two
neighbouring chunks compose to one of the same form, so the chunks of a series are
combined in a tree, ``FAN`` neighbours at a time, which gives exactly the sum of
squares of one pass over all rows, whatever the number of chunks.

Forecasting needs only (y_T, d_T, e_T) per series and is plain Spark SQL:
e_T unrolls to sum_t (-theta)^(T-t) * (d_t - phi * d_{t-1}), a grouped
aggregate, and the h-step level forecast is
    y_T + (phi * d_T + theta * e_T) * (1 - phi^h) / (1 - phi).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.operators import series as S
from demandflow.session import ensure_checkpoint_dir, ship_package

BOUND = 0.99
STEPS = (0.05, 0.01, 0.002)
CHUNK_ROWS = 100_000
TERMS = ["u", "v", "uu", "uv", "vv"]
#: Neighbouring chunks that one task composes.
FAN = 64


def grid(box: tuple[float, float, float, float], step: float) -> tuple[np.ndarray, np.ndarray]:
    """The (phi, theta) pairs of a box (phi from, to, theta from, to)."""
    axes = [np.arange(box[i], box[i + 1] + step / 2, step) for i in (0, 2)]
    p, t = np.meshgrid(*axes, indexing="ij")
    return p.ravel(), t.ravel()


def chunk_terms(d: np.ndarray, prev: np.ndarray, phis: np.ndarray, thetas: np.ndarray) -> dict:
    """What a chunk does to the residual that comes in, for every pair."""
    u, v = np.zeros_like(phis), np.ones_like(phis)
    uu, uv, vv = np.zeros_like(phis), np.zeros_like(phis), np.zeros_like(phis)
    for x, x1 in zip(d, prev):
        u = x - phis * x1 - thetas * u
        v = -thetas * v
        uu += u * u
        uv += u * v
        vv += v * v
    return dict(zip(TERMS, (u, v, uu, uv, vv)))


def compose(a: dict, b: dict) -> dict:
    """Two chunks in order as one: what b sees come in is u_a + v_a e."""
    u, v = a["u"], a["v"]
    return {"u": b["u"] + b["v"] * u, "v": b["v"] * v,
            "uu": a["uu"] + b["uu"] + 2 * u * b["uv"] + u * u * b["vv"],
            "uv": a["uv"] + v * b["uv"] + u * v * b["vv"],
            "vv": a["vv"] + v * v * b["vv"]}


def combine(chunks: list[dict]) -> np.ndarray:
    """Sum of squares per pair over the chunks of one series, in order (nothing comes in)."""
    return reduce(compose, chunks)["uu"]


def narrowed(phi: float, theta: float, step: float) -> tuple[float, float, float, float]:
    """The box around the best pair for the next, finer grid."""
    return (max(-BOUND, phi - 2 * step), min(BOUND, phi + 2 * step),
            max(-BOUND, theta - 2 * step), min(BOUND, theta + 2 * step))


def fit_css(y: np.ndarray, steps=STEPS, chunk_rows: int | None = None) -> tuple[float, float, float]:
    """(phi, theta, sigma2) of one series in memory, in chunks as the
    distributed fit has them (one chunk if not given)."""
    d = np.diff(np.asarray(y, dtype=float))
    if len(d) < 3:
        return 0.0, 0.0, float("nan")
    prev = np.r_[0.0, d[:-1]]
    size = chunk_rows or len(d)
    box = (-BOUND, BOUND, -BOUND, BOUND)
    for step in steps:
        p, t = grid(box, step)
        ss = combine([chunk_terms(d[k:k + size], prev[k:k + size], p, t) for k in range(0, len(d), size)])
        i = int(np.argmin(ss))
        box = narrowed(p[i], t[i], step)
    return round(float(p[i]), 6), round(float(t[i]), 6), float(ss[i] / len(d))


def _with_positions(df, keys, ts, target, train_frac, **layout):
    keys = [keys] if isinstance(keys, str) else list(keys)
    y = F.col(target)

    def build(w):
        return {"_d": y - F.lag(target, 1).over(w),
                "_dprev": F.lag(target, 1).over(w) - F.lag(target, 2).over(w)}
    out = S.with_series_windows(df, keys, ts, 2, build, keep=[S.ROW, S.N], **layout)
    return out.withColumn("_ntrain", F.floor(F.col(S.N) * F.lit(train_frac)).cast("long"))


def composed(chunk: DataFrame, keys: list[str], chunks: int, schema: str) -> DataFrame:
    """One row per series from at most ``chunks`` rows (keys, _c, _n, ..., terms) of each: ``FAN``
    neighbours become one row, again and again."""
    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_c")
        one = reduce(compose, ({x: np.asarray(r[x]) for x in TERMS} for _, r in pdf.iterrows()))
        out = pdf.iloc[[0]].copy()
        out["_c"], out["_n"] = out["_c"] // FAN, pdf["_n"].sum()
        for x in TERMS:
            out[x] = [one[x]]
        return out[[c for c in pdf.columns if c != "_g"]]

    while chunks > 1:
        grouped = chunk.withColumn("_g", F.floor(F.col("_c") / FAN)).groupBy(*keys, "_g")
        chunk = grouped.applyInPandas(some, schema)
        chunks = -(-chunks // FAN)
    return chunk


def css_grid(df: DataFrame, keys, ts: str, target: str, phis, thetas, train_frac: float = 0.8,
             chunk_rows: int = CHUNK_ROWS, **layout) -> DataFrame:
    """(keys, phi, theta, css): the conditional sum of squares of every given pair over the train
    rows of each series, from chunks composed in a tree."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ship_package(df.sparkSession)
    p, t = (x.ravel() for x in np.meshgrid(np.asarray(phis, float), np.asarray(thetas, float), indexing="ij"))
    pos = _with_positions(df, keys, ts, target, train_frac, **layout)
    rows = pos.where((F.col(S.ROW) < F.col("_ntrain")) & (F.col(S.ROW) >= 1)).select(
        *keys, S.ROW, "_d", F.coalesce("_dprev", F.lit(0.0)).alias("_dprev"), F.floor(F.col(S.ROW) / chunk_rows).cast("long").alias("_c"))

    def terms(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(S.ROW)
        got = chunk_terms(pdf["_d"].to_numpy(float), pdf["_dprev"].to_numpy(float), p, t)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_c": [pdf["_c"].iloc[0]], "_n": [len(pdf)], **{x: [v] for x, v in got.items()}})

    named = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{named}, _c long, _n long, " + ", ".join(f"{x} array<double>" for x in TERMS)
    chunks = (rows.agg(F.max("_c")).first()[0] or 0) + 1
    whole = composed(rows.groupBy(*keys, "_c").applyInPandas(terms, schema), keys, chunks, schema)
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("phi"), F.lit(float(b)).alias("theta")) for a, b in zip(p, t)])
    each = whole.select(*keys, F.explode(F.arrays_zip(pairs.alias("pair"), F.col("uu").alias("css"))).alias("r"))
    return each.select(*keys, "r.pair.phi", "r.pair.theta", "r.css")


def fit_arima(df: DataFrame, keys, ts: str, target: str, train_frac: float = 0.8,
              chunk_rows: int = CHUNK_ROWS, **layout) -> DataFrame:
    """One (phi, theta, sigma2, n_train) row per series, fitted on all rows of
    its train part (with fewer than three differences: 0, 0 and no sigma2)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ship_package(df.sparkSession)
    pos = _with_positions(df, keys, ts, target, train_frac, **layout)
    train = pos.where(F.col(S.ROW) < F.col("_ntrain"))
    rows = train.select(*keys, S.ROW, "_d", F.coalesce("_dprev", F.lit(0.0)).alias("_dprev"),
                        F.floor(F.col(S.ROW) / chunk_rows).cast("long").alias("_c")).persist()
    named = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    boxes = rows.select(*keys).distinct().select(
        *keys, *[F.lit(x).alias(f"_b{i}") for i, x in enumerate((-BOUND, BOUND, -BOUND, BOUND))])

    def round_(boxes: DataFrame, step: float) -> DataFrame:
        def terms(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(S.ROW)
            box = tuple(pdf[f"_b{i}"].iloc[0] for i in range(4))
            inner = pdf[pdf[S.ROW] >= 1]          # the first row of a series has no difference
            got = chunk_terms(inner["_d"].to_numpy(float), inner["_dprev"].to_numpy(float), *grid(box, step))
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_c": [pdf["_c"].iloc[0]], "_n": [len(pdf)],
                                 **{f"_b{i}": [box[i]] for i in range(4)}, **{t: [x] for t, x in got.items()}})

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            n = int(pdf["_n"].iloc[0])
            p, t = grid(tuple(pdf[f"_b{i}"].iloc[0] for i in range(4)), step)
            ss = np.asarray(pdf["uu"].iloc[0])
            i = int(np.argmin(ss))
            fitted = n > 3
            phi, theta = (float(p[i]), float(t[i])) if fitted else (0.0, 0.0)
            box = narrowed(phi, theta, step)
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{f"_b{i}": [box[i]] for i in range(4)},
                                 "phi": [round(phi, 6)], "theta": [round(theta, 6)],
                                 "sigma2": [float(ss[i] / (n - 1)) if fitted else None], "n_train": [n]})
        boxed = ", ".join(f"_b{i} double" for i in range(4))
        schema = f"{named}, _c long, _n long, {boxed}, " + ", ".join(f"{t} array<double>" for t in TERMS)
        chunk = rows.join(boxes, keys).groupBy(*keys, "_c").applyInPandas(terms, schema)
        chunk = composed(chunk, keys, chunks, schema)
        return chunk.groupBy(*keys).applyInPandas(
            best, f"{named}, {boxed}, phi double, theta double, sigma2 double, n_train long")

    ensure_checkpoint_dir(df.sparkSession)
    chunks = (rows.agg(F.max("_c")).first()[0] or 0) + 1
    for step in STEPS:                            # one row per series: cut, not nested
        fit = round_(boxes, step).checkpoint(eager=True)
        boxes = fit.select(*keys, *[f"_b{i}" for i in range(4)])
    rows.unpersist()
    return fit.select(*keys, "phi", "theta", "sigma2", "n_train")


def arima_forecast(df: DataFrame, keys, ts: str, target: str, params: DataFrame,
                   train_frac: float = 0.8, carry=(), **layout) -> DataFrame:
    """Forecast every test row of every series from its parameters
    (``params``: keys, phi, theta). Returns keys, ts, h, actual, forecast and
    the columns named in ``carry`` (which need no join, whatever the ties)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    # read by the state aggregate and by the test rows: kept once instead of
    # recomputing the input and its window twice (the two branches prune
    # different columns, so the exchange could not be reused)
    pos = _with_positions(df, keys, ts, target, train_frac, **layout).join(
        params.select(*keys, "phi", "theta"), keys).persist()
    big_t = F.col("_ntrain") - 1
    u = F.when(F.col(S.ROW) >= 1,
               F.col("_d") - F.col("phi") * F.coalesce(F.col("_dprev"), F.lit(0.0)))
    train = pos.where(F.col(S.ROW) < F.col("_ntrain"))
    state = train.groupBy(*keys).agg(
        F.max_by(target, S.ROW).alias("_yT"),
        F.max_by("_d", S.ROW).alias("_dT"),
        F.sum(F.pow(-F.col("theta"), big_t - F.col(S.ROW)) * u).alias("_eT"))
    test = pos.where(F.col(S.ROW) >= F.col("_ntrain")).join(state, keys)
    h = F.col(S.ROW) - big_t
    phi, theta = F.col("phi"), F.col("theta")
    step = phi * F.coalesce(F.col("_dT"), F.lit(0.0)) + theta * F.coalesce(F.col("_eT"), F.lit(0.0))
    fc = F.col("_yT") + step * (1 - F.pow(phi, h)) / (1 - phi)
    return test.select(*keys, ts, h.cast("long").alias("h"), F.col(target).alias("actual"),
                       fc.alias("forecast"), *carry)
