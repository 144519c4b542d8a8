"""Mixing sources to target weights with Pareto order sampling.

Sources share a budget of words by weight; a source's target stops at ``max_copies``
times its size and the excess is shared again by weight among the others until none
is above. A document with weight ``w`` (1 unless a weight column is given) is expected
``e = min(max_copies, rate * w)`` times, where its source's rate makes the expected
words equal the target. ``floor(e)`` whole copies are allocated for certain; one more
is drawn with inclusion probability ``p = e - floor(e)`` by Pareto order sampling:
documents are ranked by ``[u / (1 - u)] / [p / (1 - p)]``, ``u`` being a uniform number
fixed by a hash of key and seed, and taken in that order while their words come nearer
to what the whole copies leave of the target (a sample of fixed size in words).

No text moves: sizes are summed in rank bins, the bin that holds a source's cut is
divided again until few documents remain, and the decision is a comparison with a
per-source table. A source with a third of all rows is summed in pre-aggregated bins
like any other.

Defined cases: null text has size 0; a null source is a source of its own, last in
code point order; equal (key, text) rows are taken together; documents of size 0 take
no words; a source without words has target 0; other columns are passed through; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from demandflow.llm.common import free_name, ranked, stored, words

#: Bins per division of a source's rank range; documents of a bin ranked one by one.
BINS, EXACT = 4096, 1_000
#: Random numbers are odd multiples of 2**-49.
UNIT_BITS = 48
#: Narrowest bin: what is left there are rows of equal rank. A rank beyond all others.
NARROW, BEYOND = 1e-11, 1e9


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1, fixed by key and seed (md5: alike in any engine)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    digits = F.conv(F.substring(F.md5(name), 1, UNIT_BITS // 4), 16, 10)
    return (digits.cast("double") + 0.5) / F.lit(float(2 ** UNIT_BITS))


def source_targets(sizes: DataFrame, cycle: tuple, share: float, max_copies: int) -> DataFrame:
    """``sizes`` has one row per source (source, source_size); adds target. Each round
    closes the sources above their stop; only sums reach the driver."""
    placed = ranked(sizes.withColumn("no", F.col("source").isNull()), "no", "source")
    at = (F.col("rank") % len(cycle) + 1).cast("int")
    base = stored(placed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), at)), "sources")
    stop = F.lit(float(max_copies)) * F.col("source_size")
    budget = share * float(base.agg(F.sum("source_size")).first()[0] or 0)
    rate, closed = 0.0, 0
    while True:
        shut = stop <= F.lit(rate) * F.col("weight")
        n, size, weight = base.agg(F.sum(shut.cast("long")), F.sum(F.when(shut, stop)), F.sum(F.when(~shut, F.col("weight")))).first()
        if not weight:  # all are closed (or there is no source)
            return base.select("source", "source_size", stop.alias("target"))
        new = (budget - float(size or 0)) / weight
        if n == closed and rate:
            return base.select("source", "source_size", F.least(stop, F.lit(rate) * F.col("weight")).alias("target"))
        rate, closed = new, n


def _expected(max_copies: int) -> Column:
    return F.least(F.lit(float(max_copies)), F.col("rate") * F.col("w"))


def _at(e: Column, u: Column) -> Column:
    """Logarithm of the Pareto rank; null where no further copy is drawn. On this scale the
    documents of a source spread alike whatever their inclusion probability."""
    p = e - F.floor(e)
    return F.when(p > 0, F.log((u / (1 - u)) / (p / (1 - p))))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source_"])


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("source", "source_")


def _rates(slim: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """source, source_size, target, rate. Documents at ``max_copies`` leave their share to
    the others, round by round, until no further one is."""
    rates, before = targets.withColumn("rate", F.lit(0.0)), 0
    while True:
        r = _named(rates)
        full = F.col("rate") * F.col("w") >= max_copies
        sums = slim.join(r.select("source_", "rate"), _same(slim, r)).groupBy("source").agg(
            F.sum(F.when(full, F.col("size")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("w"))).alias("open"), F.first("rate").alias("old"))
        new = F.when(F.col("open") > 0, (F.col("target") - max_copies * F.col("full")) / F.col("open"))
        t = _named(targets)
        rates = stored(sums.join(t, _same(sums, t)).select(
            "source", "source_size", "target", F.coalesce(new, "old").alias("rate"), "full"), "rates")
        now = slim.join(_named(rates).select("source_", "rate"), F.col("source").eqNullSafe(F.col("source_"))).agg(
            F.sum(F.when(full, F.col("size")))).first()[0] or 0
        if now == before:
            return rates.drop("full")
        before = now


def _cuts(cand: DataFrame, need: DataFrame) -> DataFrame:
    """Per source the last (at, key, tag) taken: ``cand`` (source, size, at, key, tag) are
    the documents that may get one more copy, ``need`` (source, need) the words wanted."""
    ends = _named(cand.groupBy("source").agg(F.min("at").alias("low"), (F.max("at") + NARROW).alias("high")))
    need = stored(need.join(ends, _same(need, ends)).select("source", "need", "low", "high", F.lit(0).cast("long").alias("below")), "need")
    while True:
        n = _named(need)
        inside = cand.join(n, _same(cand, n)).where("at >= low and at < high")
        place = F.least(F.lit(BINS - 1), F.floor((F.col("at") - F.col("low")) / ((F.col("high") - F.col("low")) / BINS))).cast("int")
        sums = inside.groupBy("source", place.alias("bin")).agg(
            F.sum("size").alias("in_bin"), F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"),
            F.first("need").alias("need"), F.first("below").alias("before"))
        run = F.col("before") + F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin"))
        hit = sums.withColumn("run", run).where("run >= need").groupBy("source").agg(F.min_by(
            F.struct("first", "last", (F.col("run") - F.col("in_bin")).alias("below"), "n"), "bin").alias("h"))
        # bounds at documents, so that no rounding of a bin's edge moves one
        hit = stored(_named(hit.select("source", F.col("h.first").alias("f"), F.col("h.last").alias("l"),
                                       F.col("h.below").alias("b"), F.col("h.n").alias("n"))), "bins")
        # no bin reaches the need: all are taken
        need = stored(need.join(hit, _same(need, hit), "left").select(
            "source", "need", F.coalesce("f", F.lit(BEYOND)).alias("low"), F.coalesce("l", F.lit(BEYOND)).alias("last"),
            F.coalesce("b", F.lit(0)).cast("long").alias("below"), F.coalesce("n", F.lit(0)).alias("n")), "need")
        if not need.where((F.col("n") > EXACT) & (F.col("last") - F.col("low") > 4 * NARROW)).limit(1).count():
            break
        need = need.withColumn("high", F.col("last") + F.lit(NARROW)).drop("last", "n")
    n = _named(need)
    left = cand.join(n, _same(cand, n)).where("at >= low and at <= last").groupBy("source", "need", "below", "at", "key", "tag").agg(F.sum("size").alias("size"))
    total = F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("at", "key", "tag"))
    taken = left.withColumn("total", total).where(F.col("total") + F.col("total") - F.col("size") <= 2 * F.col("need"))
    last = _named(taken.groupBy("source").agg(F.max(F.struct("at", "key", "tag")).alias("cut")))
    none = F.struct(F.col("low").alias("at"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("tag"))
    return need.join(last, _same(need, last), "left").select("source", F.coalesce("cut", none).alias("cut"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weight: str | None = None, cycle: tuple = (5, 2, 1), share: float = 1.5,
        max_copies: int = 2, seed: int = 17, out: str = "_mix") -> DataFrame:
    """``df`` with column ``out``: struct of size, source_size, target (of its source) and copies."""
    given = F.lit(1.0) if weight is None else F.greatest(F.lit(0.0), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    own = {"size": F.size(words(F.col(text))).cast("long"), "w": given, "u": uniform(F.col(key), seed),
           "key": F.coalesce(F.col(key).cast("string"), F.lit("")), "tag": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    slim = stored(df.select(F.col(source).cast("string").alias("source"), *[c.alias(n) for n, c in own.items()]), "sizes")
    targets = stored(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, share, max_copies), "targets")
    rates = _rates(slim, targets, max_copies)
    r, e = _named(rates), _expected(max_copies)
    each = slim.join(r, _same(slim, r)).select("source", "target", "size", "key", "tag", F.floor(e).alias("whole"), _at(e, F.col("u")).alias("at"))
    need = stored(each.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need")), "need")
    cuts = _named(_cuts(each.where("at is not null").select("source", "size", "at", "key", "tag"), need))
    plan = rates.join(cuts, _same(rates, cuts), "left").select("source", "source_size", "target", "rate", "cut")
    mine, name, theirs = (free_name(df, n) for n in ("_own", "_source", "_plan"))
    plan = stored(plan.select(F.col("source").alias(name), F.struct("source_size", "target", "rate", "cut").alias(theirs)), "plan")
    rows = df.withColumn(mine, F.struct(F.col(source).cast("string").alias("source"), *[c.alias(n) for n, c in own.items()]))
    j = rows.join(plan, F.col(f"{mine}.source").eqNullSafe(F.col(name)))
    e = F.least(F.lit(float(max_copies)), F.col(f"{theirs}.rate") * F.col(f"{mine}.w"))
    at = _at(e, F.col(f"{mine}.u"))
    order = F.struct(at.alias("at"), F.col(f"{mine}.key").alias("key"), F.col(f"{mine}.tag").alias("tag"))
    copies = F.floor(e).cast("long") + F.when(at.isNotNull() & (order <= F.col(f"{theirs}.cut")), 1).otherwise(0).cast("long")
    return j.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.struct(
        F.col(f"{mine}.size").alias("size"), F.col(f"{theirs}.source_size").alias("source_size"),
        F.col(f"{theirs}.target").alias("target"), copies.alias("copies")).alias(out))


def copies(df: DataFrame, **parameters) -> DataFrame:
    """The mixed documents: each row of ``df`` as often as the mix takes it."""
    out = free_name(df, "_mix")
    mixed = mix(df, out=out, **parameters).where(F.col(f"{out}.copies") > 0)
    return mixed.withColumn(out, F.explode(F.sequence(F.lit(1), F.col(f"{out}.copies").cast("int")))).select(*df.columns)
