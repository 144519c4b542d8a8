"""Ordered, row-based operations inside each series (lags, rolling windows,
chronological splits), laid out so no task ever holds a whole series.

A plain ``Window.partitionBy(series).orderBy(ts)`` puts every row of a series
into one task; if one series holds a third of the data, that task holds a
third of the data. Here every series is cut into chunks of about
``chunk_rows`` consecutive rows and the window runs per ``(series, chunk)``.
The last ``halo`` rows before a chunk are copied into it, so a lag of up to
``halo`` rows or a rolling frame of ``halo + 1`` rows is exact at the chunk
border; the copies are dropped afterwards.

The row position of each row inside its series comes from a small table of
row counts per ``(series, time bucket)``: the running sum over buckets gives
every bucket's first position, the row's rank inside its bucket does the rest.
That table grows with the time span, not with the row count, and is joined
back by broadcast only when its counted size allows it.

When no series is longer than ``chunk_rows`` (the usual case for hourly
series) one window per series is already bounded, and the cheaper one-shuffle
plan is used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandflow.functions.scalars import epoch_micros

DEFAULT_CHUNK_ROWS = 1_000_000
DEFAULT_BUCKET_WIDTH = 3600          # seconds for time columns; units for numbers
BROADCAST_BYTES = 32 << 20            # estimated size up to which a counted helper table is broadcast

ROW, N, HALO, CHUNK, BUCKET, TB = "_row", "_n", "_halo", "_chunk", "_bucket", "_tb"
HELPERS = [ROW, N, HALO, CHUNK, BUCKET, TB]


def _as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def bucket_of(df: DataFrame, col: str, width: float) -> Column:
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.TimestampNTZType):
        return F.floor(epoch_micros(c) / F.lit(max(1, int(round(width * 1_000_000)))))
    if isinstance(dt, T.TimestampType):
        return F.floor(F.unix_micros(c) / F.lit(max(1, int(round(width * 1_000_000)))))
    if isinstance(dt, T.DateType):
        return F.floor(F.unix_date(c) * F.lit(86400) / F.lit(width))
    return F.floor(c / F.lit(width))


def _min_width(df: DataFrame, col: str) -> float:
    """Smallest meaningful bucket width of an order column (1 us for times)."""
    dt = df.schema[col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return 1e-6
    if isinstance(dt, T.DateType):
        return 86400.0
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return 1.0
    return 1e-9


def row_bytes(schema: T.StructType) -> int:
    """Estimated bytes of a row; generous for types without a fixed width."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return 32 + sum(16 if isinstance(f.dataType, fixed) else 256 for f in schema.fields)


def checked_broadcast(small: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast ``small`` only when its counted rows times their estimated width stay
    under ``BROADCAST_BYTES``; otherwise the join is left to a shuffle (AQE still splits
    skewed keys and measures sizes itself)."""
    if rows is None:
        small = small.persist()
        rows = small.count()
    return F.broadcast(small) if rows * row_bytes(small.schema) <= BROADCAST_BYTES else small


def with_tie_break(df: DataFrame) -> DataFrame:
    """Adds a hash of the whole row: rows of equal order are placed by it in every layout,
    so positions, lags and splits do not depend on the input's row order (only
    interchangeable rows stay tied)."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in HELPERS
            and "map<" not in f.dataType.simpleString()]
    return df.withColumn(TB, F.xxhash64(*cols))


def index_series(df: DataFrame, keys, order, halo: int = 0,
                 chunk_rows: int = DEFAULT_CHUNK_ROWS,
                 bucket_width: float = DEFAULT_BUCKET_WIDTH,
                 max_rows: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """Add ``_row`` (0-based position by ``order`` inside the series), ``_n``
    (series length) and ``_halo`` (row is a copy from the previous chunk).

    Returns the frame and a WindowSpec, ordered like ``order``, whose
    partitions hold at most about ``chunk_rows + halo`` rows. Window columns
    computed over it are exact for frames reaching back at most ``halo`` rows.
    Callers drop ``_halo`` rows afterwards (see :func:`with_series_windows`).

    ``max_rows`` is an upper bound of rows per series already known to the
    caller (e.g. from an earlier layout of the same rows before a filter);
    when it fits one chunk the counting pass is skipped.
    """
    keys, order = _as_list(keys), _as_list(order)
    if halo >= chunk_rows:
        raise ValueError("halo must be smaller than chunk_rows")
    if max_rows is not None and max_rows <= chunk_rows:
        return _single_window(df, keys, order, max_rows)
    def count_buckets(width):
        b = bucket_of(df, order[0], width)
        c = (df.groupBy(*keys, b.alias(BUCKET))
               .agg(F.count(F.lit(1)).alias("_cnt"),
                    (F.min(order[0]) == F.max(order[0])).alias("_tied")).persist())
        st = (c.groupBy(*keys).agg(F.sum("_cnt").alias("n"), F.count(F.lit(1)).alias("b"),
                                   F.max("_cnt").alias("mb"))
               .agg(F.max("n").alias("max_n"), F.sum("b").alias("buckets"),
                    F.max("mb").alias("max_bucket"))).first()
        return b, c, st

    bucket, counts, stats = count_buckets(bucket_width)
    max_n = stats["max_n"] or 0
    # a chunk never splits a bucket: while one bucket is dense enough to
    # overfill a chunk, count again with proportionally finer buckets (down
    # to the order column's unit; exact ties are split below)
    for _ in range(4):
        max_bucket = stats["max_bucket"] or 0
        if not (max_n > chunk_rows and max_bucket > chunk_rows // 2):
            break
        finer = max(bucket_width * (chunk_rows // 4) / max_bucket, _min_width(df, order[0]))
        if finer >= bucket_width:
            break
        counts.unpersist()
        bucket_width = finer
        bucket, counts, stats = count_buckets(bucket_width)

    if max_n <= chunk_rows:
        counts.unpersist()
        return _single_window(df, keys, order, max_n)

    df = with_tie_break(df)
    base = df.withColumn(BUCKET, bucket)
    order_ext = [*order, TB]
    part = max(1, chunk_rows // 4)
    heavy = (counts.where((F.col("_cnt") > chunk_rows // 2) & F.col("_tied"))
                   .select(*keys, F.col(BUCKET).alias("_b0"),
                           F.ceil(F.col("_cnt") / F.lit(part)).alias("_m")))
    heavy = checked_broadcast(heavy)
    if heavy.limit(1).count():
        # buckets too large for a chunk whose rows share one exact order
        # value: their order among themselves is arbitrary, so split them by
        # a hash of the whole row, which also breaks the ties in every
        # ordering (only byte-identical, interchangeable rows stay tied)
        base = (df.withColumn("_b0", bucket)
                  .join(heavy, [*keys, "_b0"], "left")
                  .withColumn(BUCKET, F.struct(F.col("_b0").alias("b"),
                                               F.coalesce(F.pmod(F.col(TB), F.col("_m")),
                                                          F.lit(0)).alias("s")))
                  .drop("_b0", "_m"))
        counts.unpersist()
        counts = base.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_cnt")).persist()
        stats = (counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
                       .agg(F.sum("b").alias("buckets"))).first()

    # --- chunked plan: bucket table -> first row of each bucket -> chunks ----
    by_series = Window.partitionBy(*keys)
    bt = bucket_starts(counts, keys).withColumn("_k", F.floor(F.col("_start") / F.lit(chunk_rows)))
    ch = bt.groupBy(*keys, "_k").agg(F.min("_start").alias("_f"))
    wk = by_series.orderBy("_k")
    ch = (ch.withColumn("_k1", F.lead("_k", 1).over(wk)).withColumn("_f1", F.lead("_f", 1).over(wk))
            .withColumn("_k2", F.lead("_k", 2).over(wk)).withColumn("_f2", F.lead("_f", 2).over(wk)))
    end = F.col("_start") + F.col("_cnt")
    # a bucket is copied into a later chunk when it overlaps the `halo` rows
    # before that chunk's first row; with halo < chunk_rows at most two chunks
    targets = F.filter(
        F.array(F.struct(F.col("_k").alias("k"), F.lit(False).alias("h"), F.lit(True).alias("keep")),
                F.struct(F.col("_k1").alias("k"), F.lit(True).alias("h"),
                         (F.col("_f1").isNotNull() & (F.col("_f1") < end + halo)).alias("keep")),
                F.struct(F.col("_k2").alias("k"), F.lit(True).alias("h"),
                         (F.col("_f2").isNotNull() & (F.col("_f2") < end + halo)).alias("keep"))),
        lambda s: s["keep"])
    bt = (bt.join(ch, [*keys, "_k"])
            .select(*keys, BUCKET, "_start", N, targets.alias("_targets")))
    bt = checked_broadcast(bt, rows=stats["buckets"])

    frame = (base
               .join(bt, [*keys, BUCKET])
               .withColumn("_t", F.explode("_targets"))
               .withColumn(CHUNK, F.col("_t.k")).withColumn(HALO, F.col("_t.h"))
               .drop("_t", "_targets")
               .repartition(*keys, CHUNK))
    in_bucket = Window.partitionBy(*keys, CHUNK, BUCKET).orderBy(*order_ext)
    frame = (frame.withColumn(ROW, F.col("_start") + F.row_number().over(in_bucket) - 1)
                  .drop("_start"))
    # ordering by (bucket, order) keeps one sort for both windows
    return frame, Window.partitionBy(*keys, CHUNK).orderBy(BUCKET, *order_ext)


#: Buckets of a series that one task orders.
BLOCK_BUCKETS = 4096


def bucket_starts(counts: DataFrame, keys) -> DataFrame:
    """The bucket table (keys, bucket, _cnt) with ``_start``, the rows of the series before each
    bucket, and the series' length. Prefix sums in two levels: totals of blocks of buckets, then
    inside each block, so no task holds all buckets of a long series. Blocks are ranges of
    bucket numbers, sized by the longest range that any series covers."""
    number = F.col(f"{BUCKET}.b") if isinstance(counts.schema[BUCKET].dataType, T.StructType) else F.col(BUCKET)
    span = counts.groupBy(*keys).agg((F.max(number) - F.min(number) + 1).alias("s"), F.count(F.lit(1)).alias("c")).agg(
        F.max("s").alias("s"), F.max("c").alias("c")).first()
    wide = max(1, int(span["s"] or 1) // max(1, -(-int(span["c"] or 1) // BLOCK_BUCKETS)))
    parts = counts.withColumn("_blk", F.floor(number / F.lit(wide)))
    by_series = Window.partitionBy(*keys)
    blocks = parts.groupBy(*keys, "_blk").agg(F.sum("_cnt").alias("_tot"))
    before = by_series.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_blk", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_blk0"),
                           F.sum("_tot").over(by_series).alias(N))
    inside = Window.partitionBy(*keys, "_blk").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return (parts.withColumn("_in", F.coalesce(F.sum("_cnt").over(inside), F.lit(0)))
                 .join(blocks, [*keys, "_blk"])
                 .withColumn("_start", F.col("_blk0") + F.col("_in")).drop("_blk", "_blk0", "_in"))


def _single_window(df, keys, order, max_n):
    w = Window.partitionBy(*keys).orderBy(*order, TB)
    frame = (with_tie_break(df).withColumn(ROW, F.row_number().over(w) - 1)
               .withColumn(N, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
               .withColumn(HALO, F.lit(False)))
    frame.series_max_rows = max_n          # bound handed to later layouts of these rows
    return frame, w


def series_max_rows(df: DataFrame) -> int | None:
    """Rows-per-series bound recorded by an earlier layout, if any."""
    return getattr(df, "series_max_rows", None)


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in HELPERS if c in df.columns])


def with_series_windows(df: DataFrame, keys, order, halo: int,
                        build: Callable[[WindowSpec], dict[str, Column]],
                        keep: Sequence[str] = (), **layout) -> DataFrame:
    """Add the columns returned by ``build(window)`` and return whole rows."""
    frame, w = index_series(df, keys, order, halo=halo, **layout)
    out = frame.withColumns(build(w)).where(~F.col(HALO))
    out = out.drop(*[c for c in HELPERS if c in out.columns and c not in keep])
    out.series_max_rows = series_max_rows(frame)
    return out


# --- window features (W1-W3, W6) ---------------------------------------------

def _lag_cols(w, target, lags, suffix=""):
    cols = {}
    for n in dict.fromkeys(lags):            # lookback=1 would repeat lag 1 (Q18)
        cols[f"{target}_lag{n}{suffix}"] = F.lag(target, n).over(w)
    return cols


def _roll_cols(w, target, windows, stats, include_current=True):
    cols = {}
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)
        for s in stats:
            name = f"{target}_roll{n}_{s}"
            if s == "mean":
                cols[name] = F.avg(target).over(frame)
            elif s == "std":
                cols[name] = F.coalesce(F.stddev_samp(target).over(frame), F.lit(0.0))
            elif s == "min":
                cols[name] = F.min(target).over(frame)
            elif s == "max":
                cols[name] = F.max(target).over(frame)
            else:
                raise ValueError(f"unknown rolling statistic {s}")
    return cols


def lag_features(df, keys, ts, target, lags=(1, 24, 168), suffix="", **layout):
    return with_series_windows(df, keys, ts, max(lags),
                               lambda w: _lag_cols(w, target, lags, suffix), **layout)


def rolling_features(df, keys, ts, target, windows=(6, 12, 24), stats=("mean", "std"),
                     include_current=True, **layout):
    halo = max(windows) - 1 if include_current else max(windows)
    return with_series_windows(df, keys, ts, halo,
                               lambda w: _roll_cols(w, target, windows, stats, include_current),
                               **layout)


def series_features(df, keys, ts, target, lags=(1, 24, 168), windows=(6, 12, 24),
                    stats=("mean", "std"), include_current=True, **layout):
    """Lags and rolling statistics in one pass (one shuffle)."""
    halo = max([*lags, *(w - 1 if include_current else w for w in windows), 0])

    def build(w):
        cols = _lag_cols(w, target, lags)
        cols.update(_roll_cols(w, target, windows, stats, include_current))
        return cols
    return with_series_windows(df, keys, ts, halo, build, **layout)


def naive_forecast(df, keys, ts, target, season=24, name="naive_pred", **layout):
    """Seasonal-naive forecast: the value ``season`` rows earlier."""
    return with_series_windows(df, keys, ts, season,
                               lambda w: {name: F.lag(target, season).over(w)}, **layout)


# --- positional selections (P8, P9) -----------------------------------------

def chrono_split(df, keys, ts, train_frac=0.8, col="split", **layout):
    """Per series: the first ``floor(n * train_frac)`` rows are 'train', the
    rest 'test' (P8, as ``iloc[:int(n*0.8)]``)."""
    frame, _ = index_series(df, keys, ts, halo=0, **layout)
    cut = F.floor(F.col(N) * F.lit(train_frac))
    out = frame.withColumn(col, F.when(F.col(ROW) < cut, "train").otherwise("test"))
    return drop_helpers(out.where(~F.col(HALO)))


def head_rows(df, keys, ts, n, **layout):
    frame, _ = index_series(df, keys, ts, **layout)
    return drop_helpers(frame.where(~F.col(HALO) & (F.col(ROW) < n)))


def tail_rows(df, keys, ts, n, **layout):
    frame, _ = index_series(df, keys, ts, **layout)
    return drop_helpers(frame.where(~F.col(HALO) & (F.col(ROW) >= F.col(N) - n)))


def stacking_folds(df, keys, ts, n_folds=5, col="fold", **layout):
    """Contiguous folds of an unshuffled K-fold (first n % K folds one row
    longer), from row position and series length; no extra window."""
    frame, _ = index_series(df, keys, ts, **layout)
    q = F.floor(F.col(N) / n_folds)
    r = F.col(N) - q * n_folds
    big = r * (q + 1)
    i = F.col(ROW)
    fold = F.when(i < big, F.floor(i / (q + 1))).otherwise(r + F.floor((i - big) / q))
    return drop_helpers(frame.where(~F.col(HALO)).withColumn(col, fold.cast("int")))


# --- order report (O1) -------------------------------------------------------

def time_order_report(df, keys, ts, step_seconds=3600, **layout):
    """Per series: rows, first/last time, repeated timestamps and gaps longer
    than ``step_seconds`` between consecutive rows."""
    keys = _as_list(keys)
    prev = with_series_windows(df.select(*keys, ts), keys, ts, 1,
                               lambda w: {"_prev": F.lag(ts, 1).over(w)}, **layout)
    delta = F.timestamp_diff("MICROSECOND", F.col("_prev"), F.col(ts)) / 1_000_000
    return (prev.groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("n_rows"),
                     F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                     F.count_if(delta == 0).alias("n_repeated_ts"),
                     F.count_if(delta > step_seconds).alias("n_gaps"),
                     F.coalesce(F.max(delta), F.lit(0)).cast("bigint").alias("max_step_seconds")))


# --- group mean joined back (J1, W4) -----------------------------------------

def diff_from_daily_mean(df, keys, ts, col, name=None):
    """``col`` minus its mean over the same calendar day (and series)."""
    keys = _as_list(keys)
    name = name or f"{col}_diff_from_daily_avg"
    day = F.to_date(ts)
    daily = (df.groupBy(*keys, day.alias("_day")).agg(F.avg(col).alias("_day_mean")))
    out = (df.withColumn("_day", day)
             .join(checked_broadcast(daily), [*keys, "_day"], "left")
             .withColumn(name, F.col(col) - F.col("_day_mean")))
    return out.drop("_day", "_day_mean")
