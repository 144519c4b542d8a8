"""Scaling, projection and clustering.

Spark ML does the distributed fitting (PCA through a d x d covariance
aggregate, K-Means through k-means||); everything else is DataFrame code.
Statistics that are joined back to every row (scaler rows, k centres,
micro-cluster maps) have a size fixed by the feature count or by k, never
by the row count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.operators import features as FE
from demandflow.operators.clean import impute_mean
from demandflow.session import ship_package, written

VEC = "_features"


def assemble(df: DataFrame, cols: Sequence[str], out: str = VEC) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def scaled_vectors(df: DataFrame, cols: Sequence[str], out: str = VEC) -> DataFrame:
    """Impute missing values (null, NaN) with the column mean, standardise
    (population std, N4) and assemble into one vector column. Every row is
    kept; a column without any value contributes zeros."""
    filled = FE.standardize(impute_mean(df, cols), cols, suffix="__z")
    filled = filled.withColumns({f"{c}__z": F.coalesce(F.col(f"{c}__z"), F.lit(0.0)) for c in cols})
    return assemble(filled, [f"{c}__z" for c in cols], out).drop(*[f"{c}__z" for c in cols])


ROWS_PER_PARTITION = 100_000


def cached_vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scaled feature vectors, cached for the repeated scans of iterative
    fits, with the partition count sized to the counted rows: iterative
    algorithms pay per task in every iteration, so tiny partitions are
    merged (``coalesce``, no shuffle) while large inputs keep their spread."""
    vec = scaled_vectors(df, cols).persist()
    n = vec.count()
    want = max(1, -(-n // ROWS_PER_PARTITION))
    if want < vec.rdd.getNumPartitions():
        small = vec.coalesce(want).persist()
        small.count()
        vec.unpersist()
        return small
    return vec


# --- PCA (C2-C4, W5) -----------------------------------------------------------

def pca_fit(df: DataFrame, cols: Sequence[str], k: int | None = None):
    """Fit PCA on standardised columns; returns (model, signs) where signs
    make the largest-magnitude loading of each component positive (N5)."""
    k = k or len(cols)
    vec = scaled_vectors(df, cols)
    model = PCA(k=k, inputCol=VEC, outputCol="_pcs").fit(vec)
    pc = model.pc.toArray()                       # d x k, small
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(k)]
    return model, signs


def pca_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Per component: explained-variance ratio, cumulative ratio, and the
    first component count reaching ``threshold`` (C2, W5). The d ratios
    come from the fitted model (d = number of features)."""
    fields = "component int, ratio double, cumulative double, k_for_threshold int"
    if df.isEmpty():
        return df.sparkSession.createDataFrame([], fields)
    model, _ = pca_fit(df, cols)
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    cum = np.cumsum(ratios)
    reach = [i + 1 for i, c in enumerate(cum) if c >= threshold - 1e-12]
    k = reach[0] if reach else None
    rows = [(i + 1, r, float(c), k) for i, (r, c) in enumerate(zip(ratios, cum))]
    return df.sparkSession.createDataFrame(rows, fields)


def pca_project(df: DataFrame, cols: Sequence[str], k: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with PC1..PCk of the standardised columns (C3); an empty table stays empty."""
    if df.isEmpty():
        return df.select(*keep, *[F.lit(None).cast("double").alias(f"PC{j + 1}") for j in range(k)])
    model, signs = pca_fit(df, cols, k)
    vec = scaled_vectors(df, cols)
    out = model.transform(vec).withColumn("_a", vector_to_array("_pcs"))
    return out.select(*keep, *[(F.col("_a")[j] * signs[j]).alias(f"PC{j + 1}") for j in range(k)])


def pca_columns(vec: DataFrame, cols: Sequence[str], k: int = 2, features: str = VEC) -> DataFrame:
    """Rows that already hold the scaled vector, with PC1..PCk added."""
    model = PCA(k=k, inputCol=features, outputCol="_pcs").fit(vec)
    pc = model.pc.toArray()
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(vec).withColumn("_a", vector_to_array("_pcs"))
    return out.withColumns({f"PC{j + 1}": F.col("_a")[j] * signs[j] for j in range(k)}).drop("_pcs", "_a")


def pca_loadings(df: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    """Long table (feature, component, loading) (C4, any k; Q11); no rows for an empty table."""
    if df.isEmpty():
        return df.sparkSession.createDataFrame([], "feature string, component int, loading double")
    model, signs = pca_fit(df, cols, k)
    pc = model.pc.toArray()
    rows = [(c, j + 1, float(pc[i, j] * signs[j])) for i, c in enumerate(cols) for j in range(k)]
    return df.sparkSession.createDataFrame(rows, "feature string, component int, loading double")


# --- K-Means (C5-C7, C10) --------------------------------------------------------

#: Rows of the sample that seeds the centres; rows times centres of a distance table in a task.
SEED_ROWS, TABLE = 10_000, 2_000_000


class CentreSet:
    """One K-Means: its number of centres and seed, the rows it is fitted on (``part``: place in
    the array column of row flags, and the flag wanted; None for all rows), and its result."""

    def __init__(self, k: int, seed: int, part: tuple[int, bool] | None = None):
        self.k, self.seed, self.part = k, seed, part
        self.centres: np.ndarray | None = None
        self.cost = float("nan")

    # the parts of a fitted Spark model that callers use
    @property
    def summary(self):
        return self

    @property
    def trainingCost(self) -> float:
        return self.cost

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)

    def transform(self, vec: DataFrame) -> DataFrame:
        return with_labels(vec, [self]).withColumn("cluster", F.col("_labels")[0]).drop("_labels")


def _seeded(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ centres from a sample; fewer if it has fewer distinct points."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and near.sum() > 0:
        centres.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def _nearest(x: np.ndarray, sets: Sequence[np.ndarray]):
    """For each set of centres: the nearest one of every row and its squared distance."""
    for c in sets:
        d2 = np.zeros((len(x), len(c)))
        for j in range(x.shape[1]):
            gap = x[:, j, None] - c[None, :, j]
            d2 += gap * gap
        at = d2.argmin(axis=1)
        yield at, d2[np.arange(len(x)), at]


def _rows(batch, features: str = "x") -> np.ndarray:
    flat = batch.column(features).flatten().to_numpy()
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def lloyd_sums(rows: DataFrame, sets: Sequence[CentreSet]) -> DataFrame:
    """One scan for all sets: (set, centre, n, sums, cost) of the rows nearest to each centre.
    ``rows`` has ``x`` and, if any set asks for a part, ``parts`` (flags). A task returns a row
    per centre."""
    held = rows.sparkSession.sparkContext.broadcast([(s.centres, s.part) for s in sets])   # k x d numbers per set
    wide = max((len(s.centres) for s in sets), default=1)

    def scan(batches):
        centres = [c for c, _ in held.value]
        total = [np.zeros((len(c), c.shape[1] + 2)) for c in centres]
        for batch in batches:
            x = _rows(batch)
            flags = _rows(batch, "parts").astype(bool) if "parts" in batch.schema.names and batch.num_rows else None
            for first in range(0, len(x), max(1, TABLE // wide)):
                some = x[first:first + max(1, TABLE // wide)]
                for i, (at, d2) in enumerate(_nearest(some, centres)):
                    part = held.value[i][1]
                    own = slice(None) if part is None else flags[first:first + len(some), part[0]] == part[1]
                    at, d2, mine = at[own], d2[own], some[own]
                    k = len(centres[i])
                    sums = [np.bincount(at, minlength=k), np.bincount(at, d2, k), *[np.bincount(at, v, k) for v in mine.T]]
                    total[i] += np.stack(sums, axis=1)
        flat = [(i, j, int(t[j, 0]), t[j, 2:].tolist(), float(t[j, 1])) for i, t in enumerate(total) for j in range(len(t)) if t[j, 0]]
        yield pa.RecordBatch.from_pylist([dict(zip(("set", "centre", "n", "sums", "cost"), r)) for r in flat], schema=pa.schema(
            [("set", pa.int32()), ("centre", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())), ("cost", pa.float64())]))

    found = rows.mapInArrow(scan, "set int, centre int, n long, sums array<double>, cost double")
    d = len(sets[0].centres[0])
    return found.groupBy("set", "centre").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(d)]).alias("sums"),
                                              F.sum("cost").alias("cost"))


def fit_sets(vec: DataFrame, sets: Sequence[CentreSet], features: str = VEC, max_iter: int = 300, tol: float = 1e-4,
             parts: str | None = None) -> list[CentreSet]:
    """Fit all sets with one scan of ``vec`` per iteration (Lloyd steps; a set leaves when no
    centre moves further than ``tol``). ``vec`` should be cached. Centres are seeded by
    k-means++ on at most ``SEED_ROWS`` rows (expected, by hash); the steps use all rows. A
    centre without rows stays where it is; without any row a set has one centre at 0."""
    ship_package(vec.sparkSession)
    rows = vec.select(vector_to_array(features).alias("x"), *([F.col(parts).cast("array<double>").alias("parts")] if parts else []))
    n = vec.count()
    share = int(min(1.0, SEED_ROWS / max(1, n)) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < share).collect() if n else []
    if n and not drawn:
        drawn = rows.limit(SEED_ROWS).collect()              # many equal rows: their hash may fall out
    x = np.array([r.x for r in drawn], np.float64)
    order = np.lexsort(x.T[::-1]) if len(x) else []          # the sample's order does not depend on the partitions
    flags = np.array([r.parts for r in drawn], bool) if parts and len(drawn) else None
    for s in sets:
        own = [i for i in order if s.part is None or flags[i, s.part[0]] == s.part[1]]
        s.centres = _seeded(x[own], s.k, s.seed) if len(own) else np.zeros((1, x.shape[1] if x.ndim == 2 else 1))
    active = list(sets) if n else []
    for _ in range(max_iter):
        if not active:
            break
        moved = set()
        new = [s.centres.copy() for s in active]
        for r in lloyd_sums(rows, active).collect():         # a row per centre
            new[r.set][r.centre] = np.array(r.sums) / r.n
        for s, c in zip(active, new):
            if np.sqrt(((s.centres - c) ** 2).sum(axis=1)).max() > tol:
                moved.add(id(s))
            s.centres = c
        active = [s for s in active if id(s) in moved]
    for s in sets:
        s.cost = 0.0
    for r in lloyd_sums(rows, sets).groupBy("set").agg(F.sum("cost").alias("cost")).collect() if n else []:
        sets[r.set].cost = r.cost
    return list(sets)


def with_labels(vec: DataFrame, sets: Sequence[CentreSet], out: str = "_labels", features: str = VEC) -> DataFrame:
    """``vec`` with the array of the nearest centre in every set, in one pass."""
    ship_package(vec.sparkSession)
    held = vec.sparkSession.sparkContext.broadcast([s.centres for s in sets])

    @F.arrow_udf("array<int>")
    def labels(x: pa.Array) -> pa.Array:
        m = x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.zeros((0, held.value[0].shape[1]))
        at = np.stack([a for a, _ in _nearest(m, held.value)], axis=1).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * at.shape[1], pa.int32()), pa.array(at.ravel()))
    return vec.withColumn(out, labels(vector_to_array(features)))


def _best(models):
    best = None
    for m in models:                # first of equal costs = lowest seed
        if best is None or m.cost < best.cost:
            best = m
    return best


def kmeans_best(vec: DataFrame, k: int, seed: int = 42, n_init: int = 10,
                features: str = VEC, max_iter: int = 300, tol: float = 1e-4) -> CentreSet:
    """Best of ``n_init`` K-Means fits by cost (N7), all from the same scans of ``vec``."""
    return _best(fit_sets(vec, [CentreSet(k, seed + i) for i in range(n_init)], features, max_iter, tol))


def kmeans_cluster(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 42,
                   n_init: int = 10, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with their cluster label (C5). An empty table stays empty."""
    vec = cached_vectors(df, cols)
    model = kmeans_best(vec, k, seed, n_init)
    out = model.transform(scaled_vectors(df, cols)).select(*keep, *cols, "cluster")
    vec.unpersist()
    return out


def cluster_centers(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 42,
                    n_init: int = 10) -> DataFrame:
    """Centres of the best fit in original units (C10): one row per cluster, none for an empty table."""
    stats = FE.scaler_stats(impute_mean(df, cols), cols)
    vec = cached_vectors(df, cols)
    empty = vec.isEmpty()
    model = kmeans_best(vec, k, seed, n_init)
    vec.unpersist()                               # the centres are on the driver now
    rows = [] if empty else [(i, *[float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centres = df.sparkSession.createDataFrame(
        rows, "cluster int, " + ", ".join(f"`{c}` double" for c in cols))
    return FE.unstandardize(centres, cols, stats)


def label_silhouettes(points: DataFrame, d: int, run: str = "run", label: str = "label", features: str = "x",
                      weight: str | None = None, pack: int = 1000) -> DataFrame:
    """(run, silhouette, n_points) of several labellings at once (C9; rows: run, label, x as
    array and how many rows they stand for): squared Euclidean silhouette from the sums of each
    cluster, singletons 0, no row for a labelling with one cluster. Clusters meet a row in
    arrays of at most about ``pack``."""
    x = [F.col("_x")[i] for i in range(d)]
    w = F.col("_w")
    pts = points.select(F.col(run).alias("run"), F.col(label).alias("_l"), F.col(features).alias("_x"),
                        (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    pts = pts.withColumn("_n2", reduce(add, [v * v for v in x]))
    sums = written(pts.groupBy("run", "_l").agg(F.sum(w).alias("n"), F.sum(w * F.col("_n2")).alias("q"),
                                                F.array(*[F.sum(w * v) for v in x]).alias("s")), "sums")
    many = sums.groupBy("run").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    place = F.pmod(F.xxhash64("_l"), F.lit(max(1, -(-many // pack))))
    packs = sums.groupBy("run", place.alias("_pack")).agg(F.collect_list(F.struct("_l", "n", "q", "s")).alias("_cs"))

    def summed(c):                                # squared distances to all rows of a cluster
        return c["n"] * F.col("_n2") - 2 * reduce(add, [v * c["s"][i] for i, v in enumerate(x)]) + c["q"]
    other = F.transform(F.filter("_cs", lambda c: c["_l"] != F.col("_l")), lambda c: summed(c) / c["n"])
    if many > pack:                               # several arrays per row: the least of their results
        near = pts.withColumn("_id", F.monotonically_increasing_id()).join(packs, "run").withColumn("_b", F.array_min(other))
        near = near.groupBy("run", "_l", "_id", "_n2", "_x", "_w").agg(F.min("_b").alias("_b"))
    else:
        near = pts.join(packs, "run").withColumn("_b", F.array_min(other))
    near = near.join(sums.select("run", "_l", F.struct("n", "q", "s").alias("_own")), ["run", "_l"])
    a = F.when(F.col("_own.n") > 1, summed(F.col("_own")) / (F.col("_own.n") - 1))
    s = F.when(F.col("_own.n") <= 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("_b") - a, F.greatest("_b", a)), F.lit(0.0)))
    return near.where("_b IS NOT NULL").groupBy("run").agg((F.sum(s * w) / F.sum(w)).alias("silhouette"), F.sum(w).alias("n_points"))


MAX_LABELS = 1000


def silhouette_sq(points: DataFrame, label: str, features: str = VEC) -> DataFrame:
    """Mean silhouette with squared Euclidean distance (C9), in linear time.

    For point x and cluster c the summed squared distance is
    n_c |x|^2 - 2 x.S_c + Q_c with S_c the vector sum and Q_c the summed
    squared norms: one aggregate gives (n_c, S_c, Q_c) for every cluster,
    k rows of d + 2 numbers that every point reads as one literal array.
    Singleton clusters score 0; fewer than 2 clusters gives null.
    """
    arr = F.col("_x")
    pts = points.select(F.col(label).alias("_l"), vector_to_array(features).alias("_x"))
    norm2 = F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v * v)
    pts = pts.withColumn("_n2", norm2)
    sums = Summarizer.sum(F.col("_v"))
    per = pts.withColumn("_v", array_to_vector("_x")).groupBy("_l").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_n2").alias("q"), vector_to_array(sums).alias("s"))
    stats = per.limit(MAX_LABELS + 1).collect()                    # k rows of d + 2 numbers
    if len(stats) > MAX_LABELS:                                    # many labels meet the rows in packs
        return label_silhouettes(pts.withColumn("run", F.lit(0)), len(stats[0]["s"]), "run", "_l", "_x").select("silhouette", "n_points")
    table = F.array(*[F.struct(F.lit(r["_l"]).alias("l"), F.lit(r["n"]).alias("n"),
                               F.lit(float(r["q"])).alias("q"),
                               F.array(*[F.lit(float(e)) for e in r["s"]]).alias("s"))
                      for r in stats])
    joined = pts.withColumn("_cs", table)

    def summed(c):
        dot = F.aggregate(F.zip_with(arr, c["s"], lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
        return c["n"] * F.col("_n2") - 2 * dot + c["q"]
    own = F.filter("_cs", lambda c: c["l"] == F.col("_l"))[0]
    others = F.filter("_cs", lambda c: c["l"] != F.col("_l"))
    a = F.when(own["n"] > 1, summed(own) / (own["n"] - 1))
    b = F.array_min(F.transform(others, lambda c: summed(c) / c["n"]))
    s = F.when(own["n"] <= 1, F.lit(0.0)).otherwise(
        F.try_divide(b - a, F.greatest(a, b)))
    scored = joined.withColumn("_s", F.coalesce(s, F.lit(0.0)))
    sil = F.avg("_s") if len(stats) >= 2 else F.lit(None).cast("double")
    return scored.agg(sil.alias("silhouette"), F.count(F.lit(1)).alias("n_points"))


def select_k(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 11), seed: int = 42,
             n_init: int = 10, with_silhouette: bool = True) -> DataFrame:
    """Silhouette (squared, linear time) and inertia per k (C6, C7): the fits of every k and seed
    share their scans; ``best`` flags the highest silhouette, lowest k on ties."""
    vec = cached_vectors(df, cols)
    ks = [int(k) for k in ks]
    empty = vec.isEmpty()
    sets = [] if empty else fit_sets(vec, [CentreSet(k, seed + i) for k in ks for i in range(n_init)])
    best = [_best(sets[j * n_init:(j + 1) * n_init]) for j in range(len(ks))] if sets else []
    sil = {}
    if with_silhouette and best:
        rows = with_labels(vec, best).select(vector_to_array(VEC).alias("x"), F.posexplode("_labels").alias("run", "label"))
        sil = {r.run: r.silhouette for r in label_silhouettes(rows, len(cols)).collect()}     # a row per k
    rows = [(k, sil.get(j), float(m.cost)) for j, (k, m) in enumerate(zip(ks, best))]
    vec.unpersist()
    scored = [r for r in rows if r[1] is not None]
    top = min(scored, key=lambda r: (-r[1], r[0]))[0] if scored else None
    return df.sparkSession.createDataFrame([(*r, r[0] == top) for r in rows],
                                           "k int, silhouette double, inertia double, best boolean")


def adjusted_rand(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings (C12), per group of ``by``, from the contingency
    counts: one grouped aggregate, then sums over its cells."""
    by = list(by)
    cont = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("nij"))

    def c2(x):                       # in double: the product of counts may exceed a long
        return x.cast("double") * (x.cast("double") - 1) / 2
    # cells, row sums and column sums as one long table, summed in one pass
    parts = (cont.select(*by, F.lit("ij").alias("kind"), F.col("nij").alias("v"))
             .unionByName(cont.groupBy(*by, a).agg(F.sum("nij").alias("v")).select(*by, F.lit("a").alias("kind"), "v"))
             .unionByName(cont.groupBy(*by, b).agg(F.sum("nij").alias("v")).select(*by, F.lit("b").alias("kind"), "v")))
    t = parts.groupBy(*by).agg(F.sum(F.when(F.col("kind") == "ij", c2(F.col("v")))).alias("sij"),
                               F.sum(F.when(F.col("kind") == "ij", F.col("v"))).alias("n"),
                               F.sum(F.when(F.col("kind") == "a", c2(F.col("v")))).alias("sa"),
                               F.sum(F.when(F.col("kind") == "b", c2(F.col("v")))).alias("sb"))
    expected = F.col("sa") * F.col("sb") / F.nullif(c2(F.col("n")), F.lit(0.0))
    maxi = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(expected.isNull() | (maxi == expected), F.lit(1.0)).otherwise(
        (F.col("sij") - expected) / (maxi - expected))
    return t.select(*by, F.col("n").cast("long").alias("n"), ari.alias("ari"))


def label_centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector (array<double>) per label: one aggregate of vectors."""
    x = array_to_vector(F.transform(F.col(vector), lambda v: v.cast("double")))
    return df.groupBy(label).agg(Summarizer.mean(x).alias("_m")).select(label, vector_to_array("_m").alias("centre"))


MAX_CENTRES = 10_000      # centres applied as one literal array


def assign_nearest(df: DataFrame, vector: str, centres: DataFrame, label: str,
                   out: str = "nearest") -> DataFrame:
    """Nearest centre per row (J7) without a shuffle: the k centres (fitted
    like a model, k x d numbers) are one literal array and each row keeps
    the closest (ties: the smaller label)."""
    rows = sorted(centres.select(label, "centre").limit(MAX_CENTRES + 1).collect(), key=lambda r: r[0])
    if len(rows) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    cs = F.array(*[F.struct(F.lit(r[0]).alias("l"), F.array(*[F.lit(float(v)) for v in r[1]]).alias("c"))
                   for r in rows])
    x = F.transform(F.col(vector), lambda v: v.cast("double"))

    def dist(c):
        return F.aggregate(F.zip_with(x, c["c"], lambda p, q: (p - q) * (p - q)),
                           F.lit(0.0), lambda s, v: s + v)
    scored = F.transform(cs, lambda c: F.struct(dist(c).alias("d"), c["l"].alias("l")))
    best = F.array_min(scored)                  # by distance, then label
    return (df.withColumn("_best", best)
              .withColumn(out, F.col("_best.l")).withColumn(f"{out}_distance", F.sqrt("_best.d"))
              .drop("_best"))


def cluster_stability(df: DataFrame, cols: Sequence[str], k: int, n_runs: int = 5,
                      seed: int = 42, n_init: int = 10) -> DataFrame:
    """Mean ARI between (fit on 70 %, predict 30 %) and (fit on the 30 %)
    over ``n_runs`` random splits (C11): the splits are flags of the rows, and all fits share
    their scans. An empty table has no runs."""
    vec = cached_vectors(df, cols)
    flags = F.array(*[F.rand(seed + i) < 0.7 for i in range(n_runs)])
    split = written(vec.select(VEC, flags.alias("_parts")), "splits")       # drawn once
    sides = [(i, side) for i in range(n_runs) for side in (True, False)]
    best = []
    if not split.isEmpty():
        split = split.persist()
        sets = fit_sets(split, [CentreSet(k, seed + j, part) for part in sides for j in range(n_init)], parts="_parts")
        best = [_best(sets[j * n_init:(j + 1) * n_init]) for j in range(len(sides))]
    runs = df.sparkSession.createDataFrame([], "run int, n long, ari double")
    if best:
        rows = with_labels(split, best).select("_labels", F.posexplode("_parts").alias("run", "_train")).where("NOT _train")
        both = rows.select("run", F.col("_labels")[F.col("run") * 2].alias("a"), F.col("_labels")[F.col("run") * 2 + 1].alias("b"))
        runs = adjusted_rand(both, "a", "b", ["run"])
    out = runs.agg(F.avg("ari").alias("mean_ari"), F.stddev_samp("ari").alias("std_ari"), F.count(F.lit(1)).alias("n_runs"))
    vec.unpersist()
    return out


# --- Ward on weighted micro-clusters (C15) -----------------------------------------

def ward_merges_local(x: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Size-weighted Ward merges of m points (m bounded, e.g. 256).

    Node ids as in a linkage matrix: leaves 0..m-1, the merge at step s
    creates node m+s. Height = sqrt(2 * w_a * w_b / (w_a + w_b)) * |c_a - c_b|.
    """
    m = len(x)
    ids = list(range(m))
    cs = [np.asarray(v, dtype=float) for v in x]
    ws = [float(v) for v in w]
    merges = []
    for step in range(m - 1):
        C = np.array(cs)
        W = np.array(ws)
        d2 = ((C[:, None, :] - C[None, :, :]) ** 2).sum(-1)
        cost = (W[:, None] * W[None, :]) / (W[:, None] + W[None, :]) * d2
        np.fill_diagonal(cost, np.inf)
        i, j = np.unravel_index(np.argmin(cost), cost.shape)
        i, j = min(i, j), max(i, j)
        merges.append((min(ids[i], ids[j]), max(ids[i], ids[j]),
                       float(np.sqrt(2 * cost[i, j])), W[i] + W[j]))
        c_new = (C[i] * W[i] + C[j] * W[j]) / (W[i] + W[j])
        for lst, val in ((ids, m + step), (cs, c_new), (ws, W[i] + W[j])):
            del lst[j]
            lst[i] = val
    return merges


def cut_merges(m: int, merges, n_clusters: int) -> list[int]:
    """Leaf -> cluster label after replaying the first m - n_clusters
    merges; labels numbered by their smallest leaf."""
    parent = list(range(2 * m))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    for step, (a, b, _, _) in enumerate(merges[:max(0, m - n_clusters)]):
        parent[find(a)] = m + step
        parent[find(b)] = m + step
    roots = [find(i) for i in range(m)]
    first = {}
    for i, r in enumerate(roots):
        first.setdefault(r, i)
    order = {r: k for k, r in enumerate(sorted(first, key=first.get))}
    return [order[r] for r in roots]


def ward_cluster(df: DataFrame, cols: Sequence[str], n_clusters: int = 3,
                 micro: int = 256, seed: int = 42, keep: Sequence[str] = ()):
    """Agglomerative Ward clustering re-aimed for scale: K-Means to at most
    ``micro`` weighted micro-clusters, exact size-weighted Ward on those,
    and the micro -> final map (``micro`` rows) broadcast back. Returns
    (labelled rows, merges table)."""
    vec = cached_vectors(df, cols).withColumn("_p", vector_to_array(VEC))
    spark = df.sparkSession
    distinct = vec.groupBy("_p").agg(F.count(F.lit(1)).alias("c"))
    few = distinct.limit(micro + 1).count() <= micro
    if few:
        # no more distinct points than micro-clusters: Ward on the points
        # themselves (equal points weighted by their count) is exact
        pts = distinct.collect()                                   # <= micro rows
        x = np.array([r["_p"] for r in pts])
        w = np.array([r["c"] for r in pts], dtype=float)
        lab = vec
        key = "_p"
    else:
        km = KMeans(k=micro, seed=seed, featuresCol=VEC, predictionCol="_micro", maxIter=50).fit(vec)
        lab = km.transform(vec)
        sizes = {r["_micro"]: r["c"] for r in
                 lab.groupBy("_micro").agg(F.count(F.lit(1)).alias("c")).collect()}   # <= micro rows
        ids = sorted(sizes)                                        # non-empty micro-clusters
        x = np.array(km.clusterCenters())[ids]
        w = np.array([sizes[i] for i in ids], dtype=float)
        key = "_micro"
    merges = ward_merges_local(x, w)
    labels = cut_merges(len(x), merges, n_clusters)
    if few:
        mp = spark.createDataFrame([(list(map(float, pts[i]["_p"])), int(labels[i])) for i in range(len(pts))],
                                   "_p array<double>, ward_cluster int")
    else:
        mp = spark.createDataFrame([(int(ids[i]), int(labels[i])) for i in range(len(ids))],
                                   "_micro int, ward_cluster int")
    out = lab.join(F.broadcast(mp), key).select(*keep, *cols, "ward_cluster")
    mt = spark.createDataFrame([(i + 1, int(a), int(b), float(h), float(sz))
                                for i, (a, b, h, sz) in enumerate(merges)],
                               "step int, a int, b int, height double, size double")
    return out, mt
