"""Registered clustering queries.

Oracles exist for the linear-time silhouette, the adjusted Rand index and
nearest-centre assignment; model fits (PCA, K-Means, Ward) are checked by
row counts here and by numpy references in the unit tests.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from demandflow.functions.scalars import r6, ts_text
from demandflow.operators import cluster as C
from demandflow.plans import sqlgen as G
from demandflow.plans import views as V
from demandflow.plans.catalog import query

FEATS = G.CLUSTER_FEATURES


# --- silhouette, linear time (C9) ------------------------------------------------

Z_SQL = "SELECT series, " + ", ".join(
    f"""({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1
        ELSE stddev_pop({c}) OVER () END AS z{i}""" for i, c in enumerate(FEATS)) + " FROM w"

SIL_TAIL_CTES = [
    ("d", """SELECT p.l AS pl, c.l AS cl, c.n, (c.n * p.n2 - 2 * list_dot_product(p.x, c.s) + c.q) AS summed,
                  p.pid FROM pts p CROSS JOIN cs c"""),
    ("per", """SELECT pid, pl, max(CASE WHEN pl = cl THEN n END) AS own_n,
               max(CASE WHEN pl = cl AND n > 1 THEN summed / (n - 1) END) AS a,
               min(CASE WHEN pl <> cl THEN summed / n END) AS b
        FROM d GROUP BY pid, pl"""),
    ("sc", """SELECT CASE WHEN own_n <= 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END
              AS s FROM per"""),
]
SIL_FINAL = """SELECT round(CASE WHEN (SELECT count(*) FROM cs) >= 2 THEN avg(s) END, 6) AS silhouette,
       count(*) AS n_points FROM sc"""

SIL_W_CTES = [
    ("zs", Z_SQL),
    ("pts", "SELECT row_number() OVER () AS pid, series AS l, [z0, z1, z2] AS x, "
            "z0 * z0 + z1 * z1 + z2 * z2 AS n2 FROM zs"),
    ("cs", """SELECT series AS l, count(*) AS n, sum(z0 * z0 + z1 * z1 + z2 * z2) AS q,
              [sum(z0), sum(z1), sum(z2)] AS s FROM zs GROUP BY series"""),
] + SIL_TAIL_CTES


@query("silhouette_fast", V.with_views(SIL_FINAL, "w", ctes=SIL_W_CTES))
def q_silhouette_fast(spark, sf):
    w = V.weather(spark, sf)
    pts = C.scaled_vectors(w, FEATS).withColumnRenamed("series", "label")
    return C.silhouette_sq(pts, "label").withColumn("silhouette", r6("silhouette"))


EMB_CTES = [
    ("ex", "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"),
    ("eu", """SELECT label, vec_id, unnest(x) AS v, unnest(generate_series(1, len(x))) AS i FROM ex"""),
]

SIL_EMB_CTES = EMB_CTES + [
    ("pts", "SELECT vec_id AS pid, label AS l, x, list_dot_product(x, x) AS n2 FROM ex"),
    ("cs0", "SELECT label AS l, i, sum(v) AS sv FROM eu GROUP BY label, i"),
    ("cs", """SELECT c.l, n, q, list(sv ORDER BY i) AS s FROM cs0 c
       JOIN (SELECT l, count(*) AS n, sum(n2) AS q FROM pts GROUP BY l) p USING (l) GROUP BY c.l, n, q"""),
] + SIL_TAIL_CTES
SIL_EMB_SQL = "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in SIL_EMB_CTES) + "\n" + SIL_FINAL


@query("silhouette_embeddings", SIL_EMB_SQL)
def q_silhouette_embeddings(spark, sf):
    e = V.vectors(spark, sf)
    pts = e.select("label", array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
                   .alias(C.VEC))
    return C.silhouette_sq(pts, "label").withColumn("silhouette", r6("silhouette"))


# --- nearest centre and adjusted Rand (J7, C12) -------------------------------------

NEAREST_CTES = EMB_CTES + [
    ("cen", "SELECT label AS cl, i, avg(v) AS m FROM eu GROUP BY label, i"),
    ("dist", """SELECT eu.vec_id, cen.cl, sum((eu.v - cen.m) * (eu.v - cen.m)) AS d2
                FROM eu JOIN cen USING (i) GROUP BY eu.vec_id, cen.cl"""),
    ("near", """SELECT vec_id, arg_min(cl, (d2, cl)) AS nearest, min(d2) AS d2 FROM dist GROUP BY vec_id"""),
]


def _nearest(spark, sf):
    e = V.vectors(spark, sf)
    centres = C.label_centroids(e, "label", "embedding")
    return C.assign_nearest(e, "embedding", centres, "label")


@query("assign_nearest", "WITH " + ", ".join(f"{n} AS ({q})" for n, q in NEAREST_CTES) + """
SELECT ex.vec_id, ex.label, near.nearest, round(sqrt(near.d2), 4) AS nearest_distance
FROM ex JOIN near USING (vec_id)""")
def q_assign_nearest(spark, sf):
    out = _nearest(spark, sf)
    return out.select("vec_id", "label", "nearest",
                      F.round("nearest_distance", 4).alias("nearest_distance"))


ARI_SQL = """, ab AS (SELECT ex.label AS a, near.nearest AS b FROM ex JOIN near USING (vec_id)),
cont AS (SELECT a, b, count(*) AS nij FROM ab GROUP BY a, b),
t AS (SELECT (SELECT sum(nij * (nij - 1) / 2) FROM cont) AS sij,
             (SELECT sum(nij) FROM cont) AS n,
             (SELECT sum(ni * (ni - 1) / 2) FROM (SELECT a, sum(nij) AS ni FROM cont GROUP BY a)) AS sa,
             (SELECT sum(nj * (nj - 1) / 2) FROM (SELECT b, sum(nij) AS nj FROM cont GROUP BY b)) AS sb)
SELECT CAST(n AS BIGINT) AS n,
       round(CASE WHEN (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2) THEN 1.0
             ELSE (sij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) END, 6)
       AS ari FROM t"""


@query("adjusted_rand", "WITH " + ", ".join(f"{n} AS ({q})" for n, q in NEAREST_CTES) + ARI_SQL)
def q_adjusted_rand(spark, sf):
    return C.adjusted_rand(_nearest(spark, sf), "label", "nearest").withColumn("ari", r6("ari"))


# --- model fits, rows only (C2-C7, C10, C11, C15) ----------------------------------

@query("pca_variance")
def q_pca_variance(spark, sf):
    return C.pca_variance(V.weather(spark, sf), G.W_MEASURES)


@query("pca_project")
def q_pca_project(spark, sf):
    out = C.pca_project(V.weather(spark, sf), G.W_MEASURES, k=2, keep=["series", "ts"])
    return out.withColumn("ts", ts_text("ts"))


@query("pca_loadings")
def q_pca_loadings(spark, sf):
    return C.pca_loadings(V.weather(spark, sf), G.W_MEASURES, k=2)


@query("kmeans_cluster")
def q_kmeans_cluster(spark, sf):
    out = C.kmeans_cluster(V.weather(spark, sf), FEATS, k=3, keep=["series", "ts"])
    return out.withColumn("ts", ts_text("ts"))


@query("select_k")
def q_select_k(spark, sf):
    return C.select_k(V.weather(spark, sf), FEATS, ks=range(2, 11))


@query("elbow_curve")
def q_elbow_curve(spark, sf):
    return C.select_k(V.weather(spark, sf), FEATS, ks=range(2, 11),
                      with_silhouette=False).select("k", "inertia")


@query("cluster_centers")
def q_cluster_centers(spark, sf):
    return C.cluster_centers(V.weather(spark, sf), FEATS, k=3)


@query("cluster_stability")
def q_cluster_stability(spark, sf):
    return C.cluster_stability(V.weather(spark, sf), FEATS, k=3, n_runs=5)


@query("ward_cluster")
def q_ward_cluster(spark, sf):
    out, _ = C.ward_cluster(V.weather(spark, sf), FEATS, n_clusters=3, keep=["series", "ts"])
    return out.withColumn("ts", ts_text("ts"))


@query("ward_merges")
def q_ward_merges(spark, sf):
    _, merges = C.ward_cluster(V.weather(spark, sf), FEATS, n_clusters=3)
    return merges


@query("cluster_report")
def q_cluster_report(spark, sf):
    """The cluster request of the web app for all series: PCA(2) points with
    K-Means labels, joined to the silhouette of the labelling."""
    w = V.weather(spark, sf)
    vec = C.cached_vectors(w, FEATS)
    model = C.kmeans_best(vec, 3)
    vec.unpersist()
    labelled = model.transform(C.scaled_vectors(w, FEATS))
    sil = C.silhouette_sq(labelled, "cluster").first()["silhouette"]
    # the projection is one more transform of the labelled rows: nothing is joined on time
    return (C.pca_columns(labelled, FEATS, k=2).withColumn("silhouette", F.lit(sil).cast("double"))
             .select("series", ts_text("ts").alias("ts"), "PC1", "PC2", "cluster", "silhouette"))


# --- nearest neighbours and DBSCAN on all rows of W (J4, J5, O5, C13, C14) -----------

from demandflow.operators import dbscan as DB  # noqa: E402
from demandflow.operators import features as FE  # noqa: E402
from demandflow.operators import spatial as SP  # noqa: E402
from demandflow.operators.clean import impute_mean  # noqa: E402
from demandflow.operators.quantiles import quantiles  # noqa: E402

EPS, MIN_SAMPLES = 0.3, 10
Z3 = ["z0", "z1", "z2"]


def _z(spark, sf):
    """The three clustering features of every W row, standardised, to six decimals (so that
    both engines start from the same numbers), with an id in (series, ts) order."""
    w = FE.standardize(impute_mean(V.weather(spark, sf), FEATS), FEATS, suffix="__z")
    ts = ts_text("ts")
    return w.select("series", ts.alias("ts"), F.concat_ws("|", "series", ts).alias("id"), *FEATS,
                    *[r6(f"{c}__z").alias(z) for c, z in zip(FEATS, Z3)])


Z_CTES = [
    ("z", "SELECT series, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, series || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS id, "
     + ", ".join(FEATS) + ", " + ", ".join(
         f"""round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1
             ELSE stddev_pop({c}) OVER () END, 6) AS z{i}""" for i, c in enumerate(FEATS)) + " FROM w"),
    ("far", """SELECT a.id AS a, b.id AS b, sqrt((a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1)
                      + (a.z2 - b.z2) * (a.z2 - b.z2)) AS d FROM z a, z b"""),
    ("kd", "SELECT a AS id, min(d, 50) AS l FROM far GROUP BY a"),
    ("dist", "SELECT id, l[least(5, len(l))] AS d5, l[least(6, len(l))] AS d6, l[least(50, len(l))] AS d50 FROM kd"),
]


@query("kth_neighbor_distance", V.with_views("""SELECT series, ts, round(d5, 4) AS distance_5, round(d50, 4) AS distance_50
FROM z JOIN dist USING (id)""", "w", ctes=Z_CTES))
def q_kth_neighbor_distance(spark, sf):
    out = SP.kth_neighbor_distance(_z(spark, sf), "id", Z3, [5, 50])
    return out.select("series", "ts", *[F.round(c, 4).alias(c) for c in ("distance_5", "distance_50")])


@query("k_distance_curve", V.with_views("""SELECT row_number() OVER (ORDER BY d50, id) AS position, round(d50, 4) AS distance
FROM dist""", "w", ctes=Z_CTES))
def q_k_distance_curve(spark, sf):
    return SP.k_distance_curve(_z(spark, sf), "id", Z3, 50).withColumn("distance", F.round("distance", 4))


@query("k_distance_percentiles", V.with_views("""SELECT 6 AS k, 1 AS percent, round(quantile_cont(d6, 0.01), 6) AS eps FROM dist
UNION ALL SELECT 50, 10, round(quantile_cont(d50, 0.1), 6) FROM dist
UNION ALL SELECT 50, 15, round(quantile_cont(d50, 0.15), 6) FROM dist
UNION ALL SELECT 50, 20, round(quantile_cont(d50, 0.2), 6) FROM dist""", "w", ctes=Z_CTES))
def q_k_distance_percentiles(spark, sf):
    """The eps candidates: 1 % of the distance to the max(5, 2 d)-th row, 10, 15 and 20 % of the 50th."""
    rows = SP.kth_neighbor_distance(_z(spark, sf), "id", Z3, [6, 50])
    q = quantiles(rows, ["distance_6", "distance_50"], [0.01, 0.1, 0.15, 0.2])
    q = q.select(F.substring("column", 10, 9).cast("int").alias("k"), F.round(F.col("p") * 100).cast("int").alias("percent"),
                 r6("value").alias("eps"))
    return q.where("(k = 6 AND percent = 1) OR (k = 50 AND percent > 1)")


@query("epsilon_neighbor_counts", V.with_views(f"""SELECT series, ts, n_neighbors FROM z JOIN (
SELECT a AS id, count(*) AS n_neighbors FROM far WHERE d <= {EPS} GROUP BY a) USING (id)""", "w", ctes=Z_CTES))
def q_epsilon_neighbor_counts(spark, sf):
    return SP.neighbor_counts(_z(spark, sf), "id", Z3, EPS).select("series", "ts", "n_neighbors")


#: DBSCAN for every row of ``runs`` (run, eps, ms): cores, cells of side eps / sqrt(3) with cores
#: as nodes, nodes joined by core pairs within eps, borders.
LABEL_CTES = [
    ("near", "SELECT * FROM far WHERE d <= (SELECT max(eps) FROM runs)"),
    ("core", "SELECT run, a AS id FROM near JOIN runs ON d <= eps GROUP BY run, a, ms HAVING count(*) >= ms"),
    ("cell", """SELECT run, id, [floor(z0 / (eps / sqrt(3))), floor(z1 / (eps / sqrt(3))), floor(z2 / (eps / sqrt(3)))] AS c
                FROM core JOIN runs USING (run) JOIN z USING (id)"""),
    ("nd", "SELECT run, id, min(id) OVER (PARTITION BY run, c) AS node FROM cell"),
    ("ce", """SELECT DISTINCT x.run, x.node AS a, y.node AS b FROM near JOIN nd x ON x.id = near.a
              JOIN nd y ON y.id = near.b AND y.run = x.run JOIN runs ON runs.run = x.run AND d <= eps WHERE x.node <> y.node"""),
    ("reach(run, src, dst)", """SELECT DISTINCT run, node, node FROM nd
              UNION SELECT r.run, r.src, ce.b FROM reach r JOIN ce ON ce.run = r.run AND ce.a = r.dst"""),
    ("comp", "SELECT run, src AS node, min(dst) AS c FROM reach GROUP BY run, src"),
    ("num", "SELECT run, node, CAST(dense_rank() OVER (PARTITION BY run ORDER BY c) - 1 AS INTEGER) AS cluster FROM comp"),
    ("cl", "SELECT run, id, cluster FROM nd JOIN num USING (run, node)"),
    ("border", """SELECT cl.run, near.a AS id, min(cluster) AS cluster FROM near JOIN cl ON cl.id = near.b
                  JOIN runs ON runs.run = cl.run AND d <= eps GROUP BY cl.run, near.a"""),
    ("lab", """SELECT runs.run, z.id, cl.id IS NOT NULL AS is_core, coalesce(cl.cluster, border.cluster, -1) AS label
               FROM z CROSS JOIN runs LEFT JOIN cl ON cl.run = runs.run AND cl.id = z.id
               LEFT JOIN border ON border.run = runs.run AND border.id = z.id"""),
]


def _recursive(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


ONE_RUN = Z_CTES[:2] + [("runs", f"SELECT 0 AS run, {EPS} AS eps, {MIN_SAMPLES} AS ms")] + LABEL_CTES
DBSCAN_SQL = _recursive(V.with_views("SELECT series, ts, is_core, label FROM lab JOIN z USING (id)", "w", ctes=ONE_RUN))


@query("dbscan", DBSCAN_SQL)
def q_dbscan(spark, sf):
    return DB.dbscan(_z(spark, sf), "id", Z3, EPS, MIN_SAMPLES).select("series", "ts", "is_core", "label")


@query("dbscan_cluster_means", _recursive(V.with_views(f"""SELECT label, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS {c}" for c in FEATS)}
FROM lab JOIN z USING (id) WHERE label >= 0 GROUP BY label""", "w", ctes=ONE_RUN)))
def q_dbscan_cluster_means(spark, sf):
    """Mean of each feature per DBSCAN cluster, noise left out (D3)."""
    lab = DB.dbscan(_z(spark, sf), "id", Z3, EPS, MIN_SAMPLES).where("label >= 0")
    return lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(c)).alias(c) for c in FEATS])


GRID_CTES = Z_CTES + [
    ("eps", """SELECT unnest([0, 1, 2]) AS e, unnest([quantile_cont(d50, 0.1), quantile_cont(d50, 0.15), quantile_cont(d50, 0.2)]) AS eps
               FROM dist"""),
    ("runs", "SELECT 3 * e + m AS run, eps, 10 + 5 * m AS ms FROM eps, (SELECT unnest([0, 1, 2]) AS m)"),
] + LABEL_CTES + [
    ("pts", "SELECT run, id, label, z0, z1, z2, z0 * z0 + z1 * z1 + z2 * z2 AS n2 FROM lab JOIN z USING (id) WHERE label >= 0"),
    ("cs", """SELECT run, label AS cl, count(*) AS n, sum(n2) AS q, sum(z0) AS s0, sum(z1) AS s1, sum(z2) AS s2
              FROM pts GROUP BY run, label"""),
    ("dd", "SELECT p.run, id, label, cl, n, n * n2 - 2 * (z0 * s0 + z1 * s1 + z2 * s2) + q AS summed FROM pts p JOIN cs USING (run)"),
    ("ab", """SELECT run, id, max(CASE WHEN cl = label THEN n END) AS own, max(CASE WHEN cl = label AND n > 1 THEN summed / (n - 1) END) AS a,
              min(CASE WHEN cl <> label THEN summed / n END) AS b FROM dd GROUP BY run, id"""),
    ("sil", """SELECT run, avg(CASE WHEN own <= 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END) AS s
               FROM ab WHERE b IS NOT NULL GROUP BY run"""),
    ("cnt", """SELECT run, count(DISTINCT CASE WHEN label >= 0 THEN label END) AS n,
               avg(CASE WHEN label < 0 THEN 1.0 ELSE 0.0 END) AS noise FROM lab GROUP BY run"""),
    ("res", """SELECT run, eps, ms, n, noise, s, n > 1 AND noise < 0.5 AS ok FROM runs JOIN cnt USING (run) LEFT JOIN sil USING (run)"""),
    ("win", "SELECT run FROM res WHERE ok AND round(s, 10) > -1 ORDER BY round(s, 10) DESC, run LIMIT 1"),
]
GRID_SQL = _recursive(V.with_views("""SELECT round(eps, 6) AS eps, ms AS min_samples, n AS n_clusters, round(noise, 6) AS noise_share,
round(s, 6) AS silhouette, ok AS admissible, run IN (SELECT run FROM win) AS best FROM res""", "w", ctes=GRID_CTES))


@query("dbscan_grid", GRID_SQL)
def q_dbscan_grid(spark, sf):
    """eps from the k-distances x min_samples (C14), one run of all settings."""
    table = DB.Grid(_z(spark, sf), "id", Z3).table
    return table.withColumns({c: r6(c) for c in ("eps", "noise_share", "silhouette")})


@query("dbscan_best", _recursive(V.with_views("""SELECT series, ts, label FROM z LEFT JOIN (
SELECT id, label FROM lab WHERE run IN (SELECT run FROM win)) USING (id)""", "w", ctes=GRID_CTES)))
def q_dbscan_best(spark, sf):
    """Labels of the best setting of the grid."""
    return DB.Grid(_z(spark, sf), "id", Z3).labelled().select("series", "ts", "label")


# --- one K-Means step from given centres (C5) -----------------------------------------

@query("kmeans_step", V.with_views("""SELECT c AS start, count(*) AS n, round(sum(d2), 4) AS cost,
       round(avg(z0), 5) AS z0, round(avg(z1), 5) AS z1, round(avg(z2), 5) AS z2
FROM (SELECT id, arg_min(c, (d2, c)) AS c, min(d2) AS d2 FROM (
        SELECT z.id, cen.c, (z0 - m0) * (z0 - m0) + (z1 - m1) * (z1 - m1) + (z2 - m2) * (z2 - m2) AS d2 FROM z, cen) GROUP BY id)
JOIN z USING (id) GROUP BY c""", "w", ctes=[Z_CTES[0], (
    "cen", "SELECT series AS c, avg(z0) AS m0, avg(z1) AS m1, avg(z2) AS m2 FROM z GROUP BY series")]))
def q_kmeans_step(spark, sf):
    """Assignment to given centres (the mean of every series) and the centres that follow: the
    step that all fits repeat."""
    z = _z(spark, sf).select("series", F.array(*Z3).alias("x"))
    given = sorted(C.label_centroids(z, "series", "x").collect())                  # a row per series
    start = C.CentreSet(len(given), 0)
    start.centres = C.np.array([r.centre for r in given])
    names = F.array(*[F.lit(r.series) for r in given])
    step = C.lloyd_sums(z.select("x"), [start])
    return step.select(names[F.col("centre")].alias("start"), "n", F.round("cost", 4).alias("cost"),
                       *[F.round(F.col("sums")[i] / F.col("n"), 5).alias(c) for i, c in enumerate(Z3)])
