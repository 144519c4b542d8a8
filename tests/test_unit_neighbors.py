"""Nearest neighbours in blocks, DBSCAN settings in one run, K-Means sets in shared scans,
chunks of a series composed in a tree, prefix sums in two levels, out-of-fold sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandflow.operators import arima as AR
from demandflow.operators import cluster as C
from demandflow.operators import dbscan as DB
from demandflow.operators import models as MO
from demandflow.operators import series as S
from demandflow.operators import spatial as SP

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cloud(spark):
    """A sparse and a dense group, 300 equal points, missing values."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(5, 0.01, (700, 3)), np.repeat([[1.0, 2.0, 3.0]], 300, 0)]).round(4)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(5000, None, 1.0, float("nan"))]
    m = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float)
    m = np.where(np.isnan(m), np.nanmean(m, axis=0), m)
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").persist()
    return df, [r[0] for r in rows], np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))


@pytest.mark.parametrize("block", [4096, 100])
def test_kth_distance_and_counts_equal_all_pairs(cloud, block):
    df, ids, dist = cloud
    near = np.sort(dist, axis=1)
    got = {r.id: r for r in SP.kth_neighbor_distance(df, "id", COLS, [5, 50], block).collect()}
    assert len(got) == len(ids)
    assert all(np.allclose([got[i].distance_5, got[i].distance_50], [n[4], n[49]], atol=1e-12) for i, n in zip(ids, near))
    got = {r.id: r.n_neighbors for r in SP.neighbor_counts(df, "id", COLS, 0.3, block).collect()}
    assert [got[i] for i in ids] == (dist <= 0.3).sum(axis=1).tolist()


def test_distance_curve_is_sorted_and_whole(cloud):
    df, ids, dist = cloud
    got = SP.k_distance_curve(df, "id", COLS, 50, 200).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, len(ids) + 1))
    assert np.allclose([r.distance for r in got], np.sort(np.sort(dist, axis=1)[:, 49]), atol=1e-12)


def test_blocks_follow_density():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.uniform(0, 100, (1000, 2)), rng.uniform(50, 50.001, (9000, 2))])
    tree = SP.split_blocks(x, 64)
    size = np.bincount(tree.of(x), minlength=64)
    assert size.max() <= 400 and size.sum() == len(x)
    who, leaf = tree.reached(x[:200], np.full(200, 3.0))
    for i in range(200):
        inside = np.unique(tree.of(x[((x - x[i]) ** 2).sum(1) <= 9.0]))
        assert set(inside) <= set(leaf[who == i])
    assert len(SP.split_blocks(np.zeros((50, 2)), 8).low) == 1          # equal points are not cut


def _brute(dist, eps, ms):
    core = (dist <= eps).sum(1) >= ms
    lab = np.full(len(dist), -1)
    n = 0
    for i in range(len(dist)):
        if core[i] and lab[i] < 0:
            todo, lab[i] = [i], n
            while todo:
                for q in np.flatnonzero((dist[todo.pop()] <= eps) & core & (lab < 0)):
                    lab[q] = n
                    todo.append(q)
            n += 1
    edge = [lab[(d <= eps) & core] for d in dist]
    return np.where(core, lab, [min(e) if len(e) else -1 for e in edge]), core


def test_settings_in_one_run_equal_single_runs(cloud):
    df, ids, dist = cloud
    runs = [(0.02, 10), (0.5, 10), (0.5, 20), (0.9, 4)]
    points = SP.weighted_points(df, "id", COLS)
    near = SP.nearest_neighbors(points, [4, 10, 20], keep=20, block_points=150)
    found = DB.label_points(near, runs, [4, 10, 20], parts=16)
    rows = SP.rows_with(df, COLS, points.select("pid", "x").join(found, "pid").select("x", "run", "is_core", "label"))
    got = {(r.run, r.id): (r.label, r.is_core) for r in rows.collect()}
    for k, (eps, ms) in enumerate(runs):
        lab, core = _brute(dist, eps, ms)
        assert [got[k, i] for i in ids] == list(zip(lab.tolist(), core.tolist()))


def test_cells_are_compared_by_parts(spark):
    """Two dense neighbouring cells whose nearest cores are just within, or just beyond, eps."""
    rng = np.random.default_rng(5)
    for gap, joined in ((0.999, True), (1.001, False)):
        left = np.stack([rng.uniform(-0.6, 0, 400), rng.uniform(0, 0.6, 400)], axis=1)
        right = np.stack([gap + rng.uniform(0.0, 0.3, 400), rng.uniform(0, 0.6, 400)], axis=1)
        x = np.concatenate([left, right, [[0.0, 0.31], [gap, 0.31]]])
        df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x)], "id long, a double, b double")
        got = {r.id: r.label for r in DB.dbscan(df, "id", ["a", "b"], 1.0, 3, parts=16).collect()}
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        assert [got[i] for i in range(len(x))] == _brute(dist, 1.0, 3)[0].tolist()
        assert (len(set(got.values())) == 1) == joined


def test_missing_values_and_empty_tables(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 0.1, 0.1), (1, nan, 0.1), (2, None, 5.0)], "id long, a double, b double")
    got = {r.id: (r.label, r.is_core) for r in DB.dbscan(df, "id", ["a", "b"], 0.05, 2).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (-1, False)}       # a missing value is the column's mean
    none = df.limit(0)
    assert DB.dbscan(none, "id", ["a", "b"], 0.5, 2).count() == 0
    grid = DB.Grid(none, "id", ["a", "b"])
    assert grid.table.count() == 0 and grid.best is None and grid.labelled().count() == 0
    assert C.pca_variance(none, ["a", "b"]).count() == 0 and C.kmeans_cluster(none, ["a", "b"], 2).count() == 0
    assert C.cluster_centers(none, ["a", "b"], 2).count() == 0 and C.select_k(none, ["a", "b"]).count() == 0
    assert C.cluster_stability(none, ["a", "b"], 2).first().n_runs == 0


def test_sets_in_shared_scans_equal_single_fits(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for c in ((0, 0), (5, 5), (0, 8)) for a, b in rng.normal(c, 0.5, (60, 2))]
    vec = C.cached_vectors(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    specs = [(k, s) for k in (2, 3, 4) for s in (42, 43)]
    together = C.fit_sets(vec, [C.CentreSet(k, s) for k, s in specs])
    x = np.array([r[0].toArray() for r in vec.select(C.VEC).collect()])
    for (k, s), one in zip(specs, together):
        alone = C.fit_sets(vec, [C.CentreSet(k, s)])[0]
        assert np.allclose(alone.centres, one.centres) and np.isclose(alone.cost, one.cost)
        d2 = ((x[:, None] - one.centres[None]) ** 2).sum(-1)
        at = d2.argmin(1)
        assert np.isclose(d2.min(1).sum(), one.cost)
        assert np.allclose([x[at == j].mean(0) for j in range(k)], one.centres, atol=1e-3)   # a fixed point


def test_chunks_compose_in_any_tree(spark):
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=2500))
    p, t = AR.grid((-0.9, 0.9, -0.9, 0.9), 0.3)
    d = np.diff(y)
    prev = np.r_[0.0, d[:-1]]
    whole = AR.combine([AR.chunk_terms(d, prev, p, t)])
    assert np.allclose(whole, AR.combine([AR.chunk_terms(d[k:k + 7], prev[k:k + 7], p, t) for k in range(0, len(d), 7)]))
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, t int, y double")
    got = AR.css_grid(df, "k", "t", "y", [-0.5, 0.4], [0.2], train_frac=1.0, chunk_rows=20).collect()     # 125 chunks: two levels
    p, t = np.array([-0.5, 0.4]), np.array([0.2, 0.2])
    assert np.allclose(sorted(r.css for r in got), sorted(AR.combine([AR.chunk_terms(d, prev, p, t)])))


def test_many_chunks_of_one_series_stay_small_groups(spark):
    """100,000 chunks of one series: no group of more than FAN rows."""
    n = 100_000
    terms = {"u": 0.5, "v": 0.1, "uu": 1.0, "uv": 0.2, "vv": 0.3}
    chunk = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("_c"), F.lit(1).cast("long").alias("_n"),
                                  *[F.array(F.lit(v)).alias(x) for x, v in terms.items()])
    assert chunk.groupBy("k", F.floor(F.col("_c") / AR.FAN)).count().agg(F.max("count")).first()[0] <= AR.FAN
    out = AR.composed(chunk, ["k"], n, "k string, _c long, _n long, " + ", ".join(f"{x} array<double>" for x in AR.TERMS)).collect()
    one = {x: np.array([v]) for x, v in terms.items()}
    assert len(out) == 1 and out[0]["_n"] == n and np.isclose(out[0].uu[0], AR.combine([one] * n)[0])


def test_prefix_sums_of_many_buckets(spark):
    """A series of 1,000,000 buckets: starts are right and no task orders all of them."""
    n = 1_000_000
    counts = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias(S.BUCKET), (F.col("id") % 3 + 1).alias("_cnt"))
    counts = counts.union(spark.createDataFrame([("t", 7, 2), ("t", 900, 5)], "k string, id long, c long"))
    bt = S.bucket_starts(counts, ["k"])
    got = bt.where("k = 's'").agg(F.max(F.col("_start") + F.col("_cnt")), F.max(S.N), F.count("*")).first()
    total = sum(i % 3 + 1 for i in range(n))
    assert (got[0], got[1], got[2]) == (total, total, n)
    some = {r[S.BUCKET]: r["_start"] for r in bt.where(f"k = 's' AND {S.BUCKET} IN (0, 1, 2, 3, 4097, 999999)").collect()}
    assert some == {b: sum(i % 3 + 1 for i in range(b)) for b in (0, 1, 2, 3, 4097, 999999)}
    assert {(r[S.BUCKET], r["_start"], r[S.N]) for r in bt.where("k = 't'").collect()} == {(7, 0, 7), (900, 2, 7)}
    blocks = counts.where("k = 's'").groupBy(F.floor(F.col(S.BUCKET) / S.BLOCK_BUCKETS)).count()
    assert blocks.agg(F.max("count")).first()[0] <= S.BLOCK_BUCKETS and blocks.count() <= S.BLOCK_BUCKETS


def test_out_of_fold_sums_equal_separate_fits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 2))
    y = x @ np.array([2.0, -1.0]) + 3 + rng.normal(scale=0.3, size=90)
    fold = np.arange(90) // 18
    df = spark.createDataFrame([(float(a), float(b), float(v), int(f)) for (a, b), v, f in zip(x, y, fold)],
                               "a double, b double, y double, fold int")
    for alpha in (0.0, 1.0):
        got = sorted((r.y, r.predicted) for r in MO.out_of_fold(df, ["a", "b"], "y", alpha).collect())
        want = []
        for f in range(5):
            xt, yt = x[fold != f], y[fold != f]
            mx, my = xt.mean(0), yt.mean()
            w = np.linalg.solve((xt - mx).T @ (xt - mx) + alpha * np.eye(2), (xt - mx).T @ (yt - my))
            want += zip(y[fold == f], (x[fold == f] - mx) @ w + my)
        assert np.allclose(got, sorted(want))
    assert MO.out_of_fold(df.limit(0), ["a", "b"], "y").count() == 0
