"""Exact quantiles with linear interpolation (pandas ``quantile`` / numpy
``percentile`` / DuckDB ``quantile_cont``), per group and column, without
gathering a whole group in one task.

Spark's exact ``percentile`` merges every distinct value of a group into one
buffer in one task. Here a group is narrowed down first:

1. count the non-null values of each (group, column);
2. while more than ``limit`` values lie inside a target's bracket, take an
   approximate quantile grid of the bracket (``percentile_approx``, mergeable
   sketches), keep the grid cells around the wanted rank, and count exactly
   how many values fall below the new bracket;
3. count each distinct value left in each bracket (at most ``limit`` rows,
   or a few tied values) and read the two order statistics around the rank
   from running totals.

Small groups finish after step 1. The bracket table holds one row per
(group, column, probability) and is broadcast only under a counted limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandflow.operators.series import checked_broadcast
from demandflow.session import ensure_checkpoint_dir

GRID = 1000
ACCURACY = 100_000
LIMIT = 200_000


def to_long(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric columns into (keys..., column, x), nulls removed."""
    keys = list(keys)
    narrow = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    long = narrow.unpivot(keys or [], list(cols), "column", "x") if keys else \
        narrow.unpivot([], list(cols), "column", "x")
    return long.where(F.col("x").isNotNull() & ~F.isnan("x"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              keys: Sequence[str] = (), limit: int = LIMIT, grid: int = GRID,
              accuracy: int = ACCURACY, long: DataFrame | None = None) -> DataFrame:
    """Long result: keys..., column, p, value (linear interpolation)."""
    keys = list(keys)
    g = keys + ["column"]
    long = long if long is not None else to_long(df, cols, keys)
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    t = (long.groupBy(*g).agg(F.count(F.lit(1)).alias("m"))
             .withColumn("p", F.explode(probs_arr))
             .withColumn("pos", F.col("p") * (F.col("m") - 1))
             .withColumn("k1", F.floor("pos")).withColumn("k2", F.ceil("pos"))
             .withColumn("lo", F.lit(None).cast("double"))
             .withColumn("hi", F.lit(None).cast("double"))
             .withColumn("below", F.lit(0).cast("bigint")))
    t = t.persist()
    n_targets = t.count()

    def inside(data, tt):
        cond = ((F.col("lo").isNull() | (F.col("x") >= F.col("lo")))
                & (F.col("hi").isNull() | (F.col("x") <= F.col("hi"))))
        return data.join(checked_broadcast(tt, rows=n_targets), g).where(cond)

    done = t.where(F.col("m") <= limit)
    todo = t.where(F.col("m") > limit)
    finished = [done]
    rounds = 0
    open_before = None
    while True:
        # a bracket that no longer shrinks holds few distinct, tied values: what is left
        # is counted per value below, so no task gathers more than those
        left = todo.agg(F.count(F.lit(1)), F.sum("m")).first()
        if not left[0] or tuple(left) == open_before:
            break
        open_before = tuple(left)
        rounds += 1
        # approximate grid of each open bracket; in the first round every
        # bracket of a group is the whole group, so one sketch per group
        grid_p = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
        if rounds == 1:
            groups = todo.select(*g).distinct()
            approx = (long.join(checked_broadcast(groups, rows=n_targets), g)
                      .groupBy(*g).agg(F.percentile_approx("x", grid_p, accuracy).alias("q")))
            on = g
        else:
            approx = (inside(long, todo.select(*g, "p", "lo", "hi"))
                      .groupBy(*g, "p").agg(F.percentile_approx("x", grid_p, accuracy).alias("q")))
            on = [*g, "p"]
        rel = (F.col("k1") - F.col("below")) / F.col("m")
        rel2 = (F.col("k2") - F.col("below")) / F.col("m")
        i_lo = F.greatest(F.lit(0), F.floor(rel * grid) - 2).cast("int")
        i_hi = F.least(F.lit(grid), F.ceil(rel2 * grid) + 2).cast("int")
        nb = (todo.join(approx, on)
                  .withColumn("nlo", F.when(i_lo == 0, F.col("lo"))
                              .otherwise(F.try_element_at("q", i_lo + 1)))
                  .withColumn("nhi", F.when(i_hi == grid, F.col("hi"))
                              .otherwise(F.try_element_at("q", i_hi + 1)))
                  .drop("q"))
    # exact counts below / inside the new bracket
        cnt = (inside(long, nb.select(*g, "p", "lo", "hi", "nlo", "nhi"))
               .groupBy(*g, "p").agg(
                   F.count_if(F.col("nlo").isNotNull() & (F.col("x") < F.col("nlo"))).alias("add"),
                   F.count_if((F.col("nlo").isNull() | (F.col("x") >= F.col("nlo")))
                              & (F.col("nhi").isNull() | (F.col("x") <= F.col("nhi")))).alias("m2")))
        nb = (nb.join(cnt, [*g, "p"])
                .select(*g, "p", "pos", "k1", "k2",
                        F.col("nlo").alias("lo"), F.col("nhi").alias("hi"),
                        (F.col("below") + F.col("add")).alias("below"), F.col("m2").alias("m")))
        # the bracket table is small but its plan nests every earlier round
        ensure_checkpoint_dir(nb.sparkSession)
        nb = nb.checkpoint(eager=True)
        finished.append(nb.where(F.col("m") <= limit))
        todo = nb.where(F.col("m") > limit)

    # finish: count each distinct value inside the bracket and read the two
    # order statistics from running totals. A bracket still holding many rows
    # after the rounds consists of few distinct (tied) values.
    tt = finished[0]
    for f in finished[1:] + [todo]:
        tt = tt.unionByName(f)
    if rounds:
        ensure_checkpoint_dir(tt.sparkSession)
        tt = tt.checkpoint(eager=True)
        n_targets = tt.count()
    # count each distinct value once (map-side combining collapses ties). A narrowed
    # bracket is applied to the rows before the shuffle on the value; groups that were
    # small from the start have no bracket and are counted once for all targets.
    want = tt.select(*g, "p", "lo", "hi", "below", "k1", "k2")
    if rounds:
        narrow = inside(long, want.where(F.col("lo").isNotNull() | F.col("hi").isNotNull()))
        per_value = narrow.groupBy(*g, "p", "lo", "hi", "below", "k1", "k2", "x").agg(F.count(F.lit(1)).alias("c"))
        whole = want.where(F.col("lo").isNull() & F.col("hi").isNull())
        some = whole.select(*g).distinct()
        values = long.join(some, g).groupBy(*g, "x").agg(F.count(F.lit(1)).alias("c"))
        per_value = per_value.unionByName(inside(values, whole))
    else:
        values = long.groupBy(*g, "x").agg(F.count(F.lit(1)).alias("c"))
        per_value = inside(values, want)
    w = Window.partitionBy(*g, "p").orderBy("x")
    ranked = (per_value.withColumn("cum", F.col("below") + F.sum("c").over(w))
                       .withColumn("first", F.col("cum") - F.col("c")))
    hit1 = (F.col("first") <= F.col("k1")) & (F.col("k1") < F.col("cum"))
    hit2 = (F.col("first") <= F.col("k2")) & (F.col("k2") < F.col("cum"))
    picks = (ranked.where(hit1 | hit2)
                   .groupBy(*g, "p").agg(F.max(F.when(hit1, F.col("x"))).alias("v1"),
                                        F.max(F.when(hit2, F.col("x"))).alias("v2")))
    out = tt.join(picks, [*g, "p"])
    frac = F.col("pos") - F.col("k1")
    value = F.when(frac == 0, F.col("v1")).otherwise(
        F.col("v1") + (F.col("v2") - F.col("v1")) * frac)
    return out.select(*g, "p", value.alias("value"))


def quantile_wide(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                  keys: Sequence[str] = (), names: Sequence[str] | None = None, **kw) -> DataFrame:
    """One row per (keys, column) with one column per probability."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    q = quantiles(df, cols, probs, keys, **kw)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(n)
            for p, n in zip(probs, names)]
    return q.groupBy(*keys, "column").agg(*aggs)
