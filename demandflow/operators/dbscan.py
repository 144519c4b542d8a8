"""DBSCAN from nearest neighbours (C13, C14), for a few (<= 4) dimensions.

A point is a core where its ``min_samples``-th nearest row lies within eps
(:mod:`demandflow.operators.spatial` finds it in blocks that follow the density, equal rows
counted as one weighted point). Several settings are run at once: the setting is one more
key of the same jobs.

- Cells have side eps / sqrt(d), so the cores of one cell are connected and a cell with cores
  is one node. Two cells are joined when extreme cores of theirs are within eps; cells whose
  boxes are further apart never are.
- The pairs of cells left, and not yet connected by others, are compared by parts: a cell with
  at most ``PARTS`` cores by its points, a denser one by the boxes of its 8 x 8 x ... parts,
  and only parts that are neither surely near nor surely far are cut again. A task holds at
  most ``PARTS`` boxes of each side, whatever a cell holds, and the result is exact.
- A point that is no core has fewer than ``min_samples`` rows within eps, all of them in its
  list of nearest points: it joins the lowest-numbered cluster of the cores among them.

Labels follow scikit-learn: clusters numbered by their first core in id order, a border point
joins the lowest-numbered adjacent cluster, noise is -1. Missing values (null, NaN) are the
mean of their column. An empty table gives no row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.operators import spatial as SP
from demandflow.operators.cluster import label_silhouettes
from demandflow.session import ship_package, written

MAX_DIMS = 4
#: Most boxes of a cell that a task holds.
PARTS = 512

neighbor_counts = SP.neighbor_counts


def _dist2(a, b, d: int):
    """Squared distance of two coordinate arrays, as plain arithmetic (compiled code)."""
    gaps = [F.get(a, F.lit(i)) - F.get(b, F.lit(i)) for i in range(d)]
    return reduce(add, [g * g for g in gaps])


def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node, by least labels of the
    neighbours and labels of labels; the number of rounds grows with the logarithm of a
    component's extent. ``edges`` (a, b) in any direction."""
    und = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    lab = nodes.select("node", F.col("node").alias("comp"))
    while True:
        via = (und.join(lab, und["a"] == lab["node"])
                  .groupBy(und["b"].alias("node")).agg(F.min("comp").alias("c2")))
        new = (lab.join(via, "node", "left")
                  .select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("c2", "comp")).alias("comp")))
        jump = new.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        new = (new.join(jump, new["comp"] == jump["_n"], "left")
                  .select("node", "old", F.least("comp", F.coalesce("_c", "comp")).alias("comp")))
        new = written(new, "labels")
        if new.where("comp <> old").isEmpty():
            return new.select("node", "comp")
        lab = new.select("node", "comp")


def dense_index(df: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """Distinct values of ``col`` numbered 0.. in ascending order."""
    return SP.global_position(df.select(col).distinct(), [col], name).select(col, F.col(name).cast("int").alias(name))


def _settings(runs: Sequence[tuple[float, int]], ks: Sequence[int]):
    """One literal array of (run, eps, place of min_samples in ``kd``)."""
    return F.array(*[F.struct(F.lit(i).alias("run"), F.lit(float(eps)).alias("eps"), F.lit(ks.index(ms)).alias("at"))
                     for i, (eps, ms) in enumerate(runs)])


def _nodes(core: DataFrame, d: int) -> DataFrame:
    ends = [f("x", F.col("x")[i]) for i in range(d) for f in (F.min_by, F.max_by)]
    box = [F.array(*[f(F.col("x")[i]) for i in range(d)]) for f in (F.min, F.max)]
    cells = core.groupBy("run", "eps", "cell").agg(F.min("first").alias("first"), F.array(*ends).alias("ends"),
                                                   box[0].alias("low"), box[1].alias("high"))
    return written(cells.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _cell_pairs(nodes: DataFrame, d: int) -> DataFrame:
    """(run, eps, a, b, cell, ncell, touch) for cells whose boxes are within eps."""
    r = math.ceil(math.sqrt(d))
    offs = [o for o in itertools.product(range(-r, r + 1), repeat=d)
            if o > (0,) * d and sum(max(abs(v) - 1, 0) ** 2 for v in o) <= d]
    offs = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in offs])
    one = nodes.select("run", "eps", "cell", F.col("node").alias("a"), F.col("ends").alias("ea"), F.col("low").alias("la"),
                       F.col("high").alias("ha"), F.explode(offs).alias("off"))
    one = one.withColumn("ncell", F.zip_with("cell", "off", lambda p, q: p + q)).drop("off")
    two = nodes.select("run", F.col("cell").alias("ncell"), F.col("node").alias("b"), F.col("ends").alias("eb"),
                       F.col("low").alias("lb"), F.col("high").alias("hb"))
    gaps = [F.greatest(F.lit(0.0), F.get("la", F.lit(i)) - F.get("hb", F.lit(i)), F.get("lb", F.lit(i)) - F.get("ha", F.lit(i)))
            for i in range(d)]
    near = F.sqrt(reduce(add, [g * g for g in gaps])) <= F.col("eps")
    least = F.least(*[_dist2(F.get("ea", F.lit(i)), F.get("eb", F.lit(j)), d) for i in range(2 * d) for j in range(2 * d)])
    return one.join(two, ["run", "ncell"]).where(near).select(
        "run", "eps", "a", "b", "cell", "ncell", (F.sqrt(least) <= F.col("eps")).alias("touch"))


def _compare(batches):
    """Least distance of the boxes of two items: joined, surely far, or the parts to be cut again."""
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        touch, again = [], []
        for i in range(batch.num_rows):
            sides = []
            for side in ("pa", "pb"):
                parts = cols[side][i].values
                sides.append([SP._matrix(parts.field(n)) for n in ("low", "high")])
            (la, ha), (lb, hb) = sides
            most = np.zeros((len(la), len(lb)))
            least = np.zeros((len(la), len(lb)))
            for k in range(la.shape[1]):
                up, down = ha[:, k, None] - lb[None, :, k], hb[None, :, k] - la[:, k, None]
                wide, gap = np.maximum(up, down), np.maximum(0, np.maximum(-up, -down))
                most += wide * wide
                least += gap * gap
            eps = cols["eps"][i].as_py()
            joined = bool((np.sqrt(most) <= eps).any())
            touch.append(joined)
            u, v = np.nonzero(np.sqrt(least) <= eps) if not joined else ([], [])
            keys = [cols[side][i].values.field("part") for side in ("pa", "pb")]
            again.append([{"ia": keys[0][int(p)].as_py(), "ib": keys[1][int(q)].as_py()} for p, q in zip(u, v)
                          if most[p, q] > least[p, q]])
        kind = pa.list_(pa.struct([("ia", pa.list_(pa.int64())), ("ib", pa.list_(pa.int64()))]))
        yield pa.RecordBatch.from_arrays([cols["run"], cols["eps"], cols["a"], cols["b"], pa.array(touch, pa.bool_()),
                                          pa.array(again, kind)], names=["run", "eps", "a", "b", "touch", "again"])


def _joined(core: DataFrame, pairs: DataFrame, d: int, limit: int = PARTS) -> DataFrame:
    """(a, b) of the pairs (run, eps, a, b, ia, ib: cells) that have cores within eps."""
    m = max(2, int(limit ** (1 / d) + 1e-9))
    m = 1 << (m.bit_length() - 1)                        # a power of two: cells and parts nest exactly
    found, level = [], 0
    while True:
        def at(scale):
            return F.transform("q", lambda v: F.floor(v * F.lit(float(scale))))
        items = pairs.select("run", F.col("ia").alias("item")).unionByName(pairs.select("run", F.col("ib").alias("item"))).distinct()
        pts = core.select("run", "x", at(m ** level).alias("item"), at(m ** (level + 1)).alias("child")).join(items, ["run", "item"])
        size = pts.groupBy("run", "item").agg(F.count(F.lit(1)).alias("n"))
        part = F.when(F.col("n") <= limit, F.col("x")).otherwise(F.transform("child", lambda v: v.cast("double")))
        box = [F.array(*[f(F.col("x")[i]) for i in range(d)]).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
        boxes = pts.join(size, ["run", "item"]).groupBy("run", "item", part.alias("key")).agg(*box, F.min("child").alias("part"))
        boxes = boxes.groupBy("run", "item").agg(F.collect_list(F.struct("part", "low", "high")).alias("parts"))
        rows = (pairs.join(boxes.select("run", F.col("item").alias("ia"), F.col("parts").alias("pa")), ["run", "ia"])
                     .join(boxes.select("run", F.col("item").alias("ib"), F.col("parts").alias("pb")), ["run", "ib"]))
        seen = written(rows.select("run", "eps", "a", "b", "pa", "pb").mapInArrow(
            _compare, "run int, eps double, a long, b long, touch boolean, "
                      "again array<struct<ia: array<long>, ib: array<long>>>"), "compared")
        found.append(seen.where("touch").select("a", "b"))
        pairs = seen.where(F.size("again") > 0).select("run", "eps", "a", "b", F.explode("again").alias("p")).select(
            "run", "eps", "a", "b", "p.ia", "p.ib")
        # a pair that some of its parts have joined needs no further look
        pairs = pairs.join(seen.where("touch").select("a", "b").distinct(), ["a", "b"], "left_anti")
        level += 1
        if pairs.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


def label_points(near: DataFrame, runs: Sequence[tuple[float, int]], ks: Sequence[int], parts: int = PARTS) -> DataFrame:
    """(run, pid, is_core, label) of every point under every setting (eps, min_samples); ``near``
    of :func:`spatial.nearest_neighbors` with ``ks`` holding every min_samples, and lists of at
    least the largest of them. ``run`` is the place of the setting. Written."""
    ship_package(near.sparkSession)
    d = near.select(F.size("x").alias("d")).first()
    d = d.d if d else 1
    if d > MAX_DIMS:
        raise ValueError(f"grid DBSCAN supports at most {MAX_DIMS} dimensions; project first (PCA)")
    each = near.withColumn("s", F.explode(_settings(runs, list(ks)))).select(
        "pid", "first", "x", "near", "s.run", "s.eps", (F.col("kd")[F.col("s.at")] <= F.col("s.eps")).alias("is_core"))
    core = each.where("is_core").select("run", "eps", "pid", "first", "x", F.transform(
        "x", lambda v: v / (F.col("eps") / F.lit(math.sqrt(d)))).alias("q"))
    core = written(core.withColumn("cell", F.transform("q", lambda v: F.floor(v))), "cores")
    nodes = _nodes(core, d)
    pairs = written(_cell_pairs(nodes, d), "pairs")
    comps = _components(pairs.where("touch").select("a", "b"), nodes)
    ends = [comps.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}")) for n in ("a", "b")]
    open_pairs = written(pairs.where("NOT touch").join(ends[0], "a").join(ends[1], "b").where("ca <> cb").select(
        "run", "eps", F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("cell").alias("ia"), F.col("ncell").alias("ib")), "open")
    if not open_pairs.isEmpty():
        more = _joined(core, open_pairs, d, parts)
        merged = _components(more, comps.select(F.col("comp").alias("node")).distinct())
        comps = comps.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("c")), "comp").select("node", F.col("c").alias("comp"))
    # clusters of each setting numbered by their first core
    held = nodes.select("run", "node", "first", "cell").join(comps, "node")
    firsts = SP.global_position(held.groupBy("run", "comp").agg(F.min("first").alias("first")), ["run", "first"])
    start = firsts.groupBy("run").agg(F.min("position").alias("start"))           # a row per setting
    number = firsts.join(F.broadcast(start), "run").select("comp", (F.col("position") - F.col("start")).cast("int").alias("label"))
    cells = held.join(number, "comp").select("run", "cell", "label")
    cores = written(core.select("run", "pid", "cell").join(cells, ["run", "cell"]).select("run", "pid", "label"), "core-labels")
    rest = each.where("NOT is_core").select("run", "eps", "pid", "near")
    calls = rest.select("run", "pid", F.explode(F.filter("near", lambda v: F.sqrt(v["d2"]) <= F.col("eps"))).alias("v")).select(
        "run", F.col("pid").alias("asks"), F.col("v.pid").alias("pid"))
    border = calls.join(cores, ["run", "pid"]).groupBy("run", F.col("asks").alias("pid")).agg(F.min("label").alias("label"))
    edge = rest.select("run", "pid").join(border, ["run", "pid"], "left").select(
        "run", "pid", F.lit(False).alias("is_core"), F.coalesce("label", F.lit(-1)).alias("label"))
    return written(cores.select("run", "pid", F.lit(True).alias("is_core"), "label").unionByName(edge), "labels")


def dbscan(df: DataFrame, id_col: str, cols: Sequence[str], eps: float, min_samples: int = 5, label: str = "label",
           block_points: int = SP.BLOCK_POINTS, parts: int = PARTS) -> DataFrame:
    """Rows of ``df`` with a DBSCAN ``label`` (noise -1) and ``is_core``."""
    if len(cols) > MAX_DIMS:
        raise ValueError(f"grid DBSCAN supports at most {MAX_DIMS} dimensions; project first (PCA)")
    points = SP.weighted_points(df, id_col, cols)
    near = SP.nearest_neighbors(points, [min_samples], keep=min_samples, block_points=block_points)
    found = label_points(near, [(eps, min_samples)], [min_samples], parts)
    facts = points.select("pid", "x").join(found, "pid").select("x", "is_core", F.col("label").alias(label))
    return SP.rows_with(df, cols, facts)


def dbscan_summary(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Clusters (without noise), noise share."""
    return labelled.agg(F.countDistinct(F.when(F.col(label) >= 0, F.col(label))).alias("n_clusters"),
                        (F.avg((F.col(label) == -1).cast("double"))).alias("noise_share"),
                        F.count(F.lit(1)).alias("n_points"))


# --- settings from the data (C14) -------------------------------------------------------

class Grid:
    """DBSCAN with eps at ``percents`` of the distance to the min(``k``, n - 1)-th nearest row and
    each ``min_samples``: all settings labelled in one run. ``table`` has a row per setting (eps,
    min_samples, n_clusters, noise_share, silhouette, admissible, best): admissible with more
    than one cluster and less than half noise, best the admissible setting with the highest
    silhouette without noise, above -1 (first of equals); ``best`` is its place or None."""

    def __init__(self, df: DataFrame, id_col: str, cols: Sequence[str], min_samples: Sequence[int] = (10, 15, 20),
                 percents: Sequence[float] = (10, 15, 20), k: int = 50, block_points: int = SP.BLOCK_POINTS):
        from demandflow.operators.quantiles import quantiles

        self.df, self.cols = df, list(cols)
        spark = df.sparkSession
        self.points = SP.weighted_points(df, id_col, cols)
        n = self.points.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        ks = [*min_samples, max(1, min(k, n - 1))]
        near = SP.nearest_neighbors(self.points, ks, keep=max(min_samples), block_points=block_points)
        far = near.select("x", F.col("kd")[len(ks) - 1].alias("_distance"))
        dist = SP.rows_with(df.select(*cols), cols, far).select(F.col("_distance").alias("distance"))
        eps = quantiles(dist, ["distance"], [p / 100 for p in percents]).collect()
        self.eps = [r.value for r in sorted(eps, key=lambda r: r.p)]
        self.runs = [(e, m) for e in self.eps for m in min_samples]
        fields = ("eps double, min_samples int, n_clusters int, noise_share double, silhouette double, "
                  "admissible boolean, best boolean")
        if not self.runs:
            self.best, self.labels, self.table = None, None, spark.createDataFrame([], fields)
            return
        self.labels = label_points(near, self.runs, ks)
        rows = self.labels.join(self.points.select("pid", "x", "w"), "pid")
        count = {r.run: r for r in rows.groupBy("run").agg(
            F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n"),
            (F.sum(F.when(F.col("label") < 0, F.col("w")).otherwise(0)) / F.sum("w")).alias("noise")).collect()}
        sil = {r.run: r.silhouette for r in label_silhouettes(
            rows.where("label >= 0"), len(self.cols), weight="w").collect()}                # a row per setting
        out, self.best, top = [], None, -1.0
        for i, (e, m) in enumerate(self.runs):
            ok = count[i].n > 1 and count[i].noise < 0.5
            if ok and round(sil.get(i, -1.0), 10) > top:     # equal labellings tie whatever the order of their sums
                self.best, top = i, round(sil[i], 10)
            out.append([e, m, count[i].n, float(count[i].noise), sil.get(i), ok])
        self.table = spark.createDataFrame([(*r, i == self.best) for i, r in enumerate(out)], fields)

    def labelled(self, run: int | None = None, label: str = "label") -> DataFrame:
        """The rows with the labels of a setting, by default the best one's; null without any."""
        run = self.best if run is None else run
        if run is None:
            return self.df.withColumn(label, F.lit(None).cast("int"))
        facts = self.points.select("pid", "x").join(self.labels.where(F.col("run") == run), "pid").select("x", F.col("label").alias(label))
        return SP.rows_with(self.df, self.cols, facts)
