"""Nearest neighbours of all points in blocks (J4, J5, O5), for a few dimensions.

Equal points are one point with a weight, so a value that many rows share is one row. The
distinct points are dealt to blocks of a k-d tree built from a bounded sample: blocks follow
the density, so a dense spot is cut into many blocks instead of filling one grid cell.

- Inside its block each point finds its k nearest, which bounds the distance of the k-th. A
  point whose ball of that radius stays inside its block's region is done.
- Every other point visits only the blocks that its ball reaches, and brings back the nearer
  points it meets; the lists of a point are merged and cut to k.

Rows hold points and lists of at most k entries, never pairs; a task holds one block and its
visitors. The tree (at most ``MAX_BLOCKS`` leaves) is the only thing sent to every task.

Missing values (null, NaN) are the mean of their column, as everywhere in clustering. Ids
must be unique and of a type with an order; rows are numbered by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandflow.operators.clean import impute_mean
from demandflow.session import ship_package, written

#: Points wanted in a block, most blocks (a few MB of tree), sampled points per block.
BLOCK_POINTS, MAX_BLOCKS, SAMPLE = 4096, 65_536, 16
#: Numbers of a distance table that a task makes at a time.
TABLE = 4_000_000


def global_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with its place (0, 1, ...) in the order given, equal rows in any order: range
    partitions, one count per partition, and numbers inside each. Give a tie-break that
    differs between rows as last column, so that equal values are spread too."""
    parts = written(df.repartitionByRange(*[F.col(c) for c in order])
                      .withColumn("_part", F.spark_partition_id()), "positions")
    before, pairs = 0, [F.lit(-1), F.lit(0).cast("long")]
    for part, n in sorted(parts.groupBy("_part").agg(F.count(F.lit(1))).collect()):   # a row per partition
        pairs += [F.lit(part), F.lit(before).cast("long")]
        before += n
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, place + F.create_map(*pairs)[F.col("_part")]).drop("_part")


def point(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, Column]:
    """``df`` with missing values imputed, and its coordinates as one array (a column without
    any value is 0; adding 0 makes -0 and 0 the same point)."""
    filled = impute_mean(df, cols)
    return filled, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + F.lit(0.0) for c in cols])


def weighted_points(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Distinct points, written: ``pid`` (a number), ``first`` (the least id), ``x``, ``w`` (rows)."""
    filled, x = point(df, cols)
    distinct = filled.select(F.col(id_col).alias("id"), x.alias("x")).groupBy("x").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("w"))
    return written(distinct.select(F.monotonically_increasing_id().alias("pid"), "first", "x", "w"), "points")


# --- blocks --------------------------------------------------------------------------

class Blocks(NamedTuple):
    """A k-d tree: inner nodes send x[dim] < cut to ``left``, the rest to ``right``; leaves have
    dim -1 and their number in ``left``. ``low`` and ``high`` bound each leaf's region."""
    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(x), np.int64)
        while True:
            dim = self.dim[node]
            inner = np.flatnonzero(dim >= 0)
            if not len(inner):
                return self.left[node]
            at = node[inner]
            below = x[inner, dim[inner]] < self.cut[at]
            node[inner] = np.where(below, self.left[at], self.right[at])

    def reached(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every region that a ball around a point of radius r touches."""
        points, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, some = todo.pop()
            if not len(some):
                continue
            dim = self.dim[node]
            if dim < 0:
                leaf = self.left[node]
                gap = np.maximum(0, np.maximum(self.low[leaf] - x[some], x[some] - self.high[leaf]))
                some = some[np.sqrt((gap * gap).sum(axis=1)) <= r[some]]
                points.append(some)
                leaves.append(np.full(len(some), leaf))
            else:
                todo.append((self.left[node], some[x[some, dim] - r[some] < self.cut[node]]))
                todo.append((self.right[node], some[x[some, dim] + r[some] >= self.cut[node]]))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(points + none), np.concatenate(leaves + none)


def split_blocks(sample: np.ndarray, want: int) -> Blocks:
    """A tree of at most ``want`` leaves: the fullest leaf is cut at the median of its widest
    side, while any side has two values."""
    import heapq

    d = sample.shape[1]
    dim, cut, left, right = [-1], [0.0], [0], [0]
    region = {0: (np.full(d, -np.inf), np.full(d, np.inf))}
    heap = [(-len(sample), 0, np.arange(len(sample)))]
    leaves = 1
    while heap and leaves < want:
        _, node, some = heapq.heappop(heap)
        x = sample[some]
        span = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(d)
        k = int(span.argmax())
        if not span[k] > 0:
            continue                                    # one value: stays a leaf
        v = np.sort(x[:, k])
        at = v[len(v) // 2]
        at = float(at if at > v[0] else v[np.searchsorted(v, at, "right")])
        low, high = region.pop(node)
        dim[node], cut[node] = k, at
        for side, part in ((left, some[x[:, k] < at]), (right, some[x[:, k] >= at])):
            child = len(dim)
            side[node] = child
            for column, value in ((dim, -1), (cut, 0.0), (left, 0), (right, 0)):
                column.append(value)
            lo, hi = low.copy(), high.copy()
            (hi if side is left else lo)[k] = at
            region[child] = (lo, hi)
            heapq.heappush(heap, (-len(part), child, part))
        leaves += 1
    for number, node in enumerate(sorted(region)):
        left[node] = number
    bounds = [region[n] for n in sorted(region)]
    return Blocks(np.array(dim), np.array(cut), np.array(left), np.array(right),
                  np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds]))


def blocks_of(points: DataFrame, block_points: int = BLOCK_POINTS) -> Blocks:
    """The tree for a written table of distinct points, from a sample by hash whose expected
    size is bounded by the number of blocks."""
    n = points.count()
    want = max(1, min(MAX_BLOCKS, -(-n // block_points)))
    share = min(1.0, SAMPLE * want / max(1, n)) if want > 1 else 0.0
    drawn = points.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").collect() if share else []
    d = len(points.select("x").first().x) if n else 1
    return split_blocks(np.array([r.x for r in drawn], np.float64).reshape(-1, d), want)


def in_blocks(points: DataFrame, tree: Blocks) -> DataFrame:
    """``points`` with the number of their ``block``."""
    held = points.sparkSession.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def block(x: pa.Array) -> pa.Array:
        return pa.array(held.value.of(_matrix(x)).astype(np.int32))
    return points.withColumn("block", block("x"))


def _matrix(x: pa.Array) -> np.ndarray:
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    flat = x.flatten().to_numpy()
    return flat.reshape(len(x), -1) if len(x) else np.zeros((0, 1))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, summed in the order of the coordinates."""
    total = np.zeros((len(x), len(y)))
    for k in range(y.shape[1]):
        gap = x[:, k, None] - y[None, :, k]
        total += gap * gap
    return total


def _nearest(x, y, w, pid, k: int):
    """For each row of x the nearest rows of y, in pieces: (rows, d2, w, pid), sorted by distance."""
    step = max(1, TABLE // max(1, len(y)))
    for at in range(0, len(x), step):
        d2 = _distances(x[at:at + step], y)
        if len(y) > k:
            near = np.argpartition(d2, k - 1, axis=1)[:, :k]
            d2 = np.take_along_axis(d2, near, 1)
        else:
            near = np.broadcast_to(np.arange(len(y)), d2.shape)
        order = np.lexsort((pid[near], d2), axis=1)
        near = np.take_along_axis(near, order, 1)
        yield np.arange(at, at + len(d2)), np.take_along_axis(d2, order, 1), w[near], pid[near]


def _lists(size: np.ndarray, *fields: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.StructArray.from_arrays(
        [pa.array(f) for f in fields], names=["d2", "w", "pid"]))


NEAR = "array<struct<d2: double, w: bigint, pid: bigint>>"


def _first_round(held, ks: Sequence[int], keep: int, schema: pa.Schema):
    def search(rows: pa.Table) -> pa.Table:
        tree, k = held.value, max(ks)
        x, w, pid = _matrix(rows["x"]), rows["w"].to_numpy(), rows["pid"].to_numpy()
        block = rows["block"][0].as_py()
        done, kd, sizes, parts, visits = [], [], [], [], []
        for at, d2, ww, near in _nearest(x, x, w, pid, k):
            total = np.cumsum(ww, axis=1)
            place = np.stack([(total < q).sum(axis=1) for q in ks], axis=1)
            dist = np.sqrt(np.concatenate([d2, np.full((len(at), 1), np.inf)], axis=1))
            dist = np.take_along_axis(dist, np.minimum(place, d2.shape[1]), 1)
            r = dist.max(axis=1)
            inside = (np.minimum(x[at] - tree.low[block], tree.high[block] - x[at]) >= r[:, None]).all(axis=1)
            who, leaf = tree.reached(x[at], np.where(inside, -1.0, r))
            other = leaf != block
            who, leaf = who[other], leaf[other]
            alone = np.bincount(who, minlength=len(at)) == 0            # nothing else is reached
            order = np.argsort(who, kind="stable")
            visits.append((np.bincount(who, minlength=len(at)), leaf[order]))
            size = np.where(alone, min(keep, d2.shape[1]), d2.shape[1])
            mask = np.arange(d2.shape[1])[None, :] < size[:, None]
            done.append(alone)
            kd.append(dist)
            sizes.append(size)
            parts.append((d2[mask], ww[mask], near[mask]))
        kd = np.concatenate(kd)
        n = np.concatenate([v[0] for v in visits])
        out = rows.drop_columns("block")
        out = out.append_column("done", pa.array(np.concatenate(done)))
        out = out.append_column("kd", pa.ListArray.from_arrays(pa.array(np.arange(len(kd) + 1) * len(ks), pa.int32()), pa.array(kd.ravel())))
        out = out.append_column("near", _lists(np.concatenate(sizes), *[np.concatenate(c) for c in zip(*parts)]))
        return out.append_column("visits", pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.concatenate([v[1] for v in visits]).astype(np.int32))))
    return search


def _second_round(k: int):
    def search(visitors: pa.Table, rows: pa.Table) -> pa.Table:
        if not visitors.num_rows or not rows.num_rows:
            return pa.table({"pid": pa.array([], pa.int64()), "near": _lists(np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0, int))})
        x, r = _matrix(visitors["x"]), visitors["r"].to_numpy()
        y, w, pid = _matrix(rows["x"]), rows["w"].to_numpy(), rows["pid"].to_numpy()
        sizes, parts = [], []
        for at, d2, ww, near in _nearest(x, y, w, pid, k):
            mask = np.sqrt(d2) <= r[at, None]
            sizes.append(mask.sum(axis=1))
            parts.append((d2[mask], ww[mask], near[mask]))
        return pa.table({"pid": visitors["pid"], "near": _lists(np.concatenate(sizes), *[np.concatenate(c) for c in zip(*parts)])})
    return search


def nearest_neighbors(points: DataFrame, ks: Sequence[int], keep: int = 0, block_points: int = BLOCK_POINTS) -> DataFrame:
    """``points`` (of :func:`weighted_points`) with ``kd``: the distance to the k-th nearest row
    for each of ``ks``, the point itself counted, infinite where there are fewer rows; and
    ``near``: its ``keep`` nearest distinct points or more (squared distance, rows, pid). Written."""
    ship_package(points.sparkSession)
    tree = blocks_of(points, block_points)
    placed = in_blocks(points, tree)
    if len(tree.low) > 1:
        placed = written(placed, "blocks")
    held = points.sparkSession.sparkContext.broadcast(tree)
    k = max(ks)
    first = points.schema["first"].dataType.simpleString()
    schema = f"pid long, first {first}, x array<double>, w long, done boolean, kd array<double>, near {NEAR}, visits array<int>"
    seen = written(placed.groupBy("block").applyInArrow(_first_round(held, ks, keep, None), schema), "neighbors")
    if len(tree.low) == 1:
        return seen.select("pid", "first", "x", "w", "kd", "near")
    border = seen.where(~F.col("done"))
    calls = border.select("pid", "x", F.array_max("kd").alias("r"), F.explode("visits").alias("block"))
    met = calls.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_second_round(k), f"pid long, near {NEAR}")
    lists = border.select("pid", "near").unionByName(met).groupBy("pid").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))

    def kth(q):
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d2"))
        step = F.aggregate("near", start, lambda acc, v: F.struct(
            (acc.n + v.w).alias("n"), F.when(acc.d2.isNull() & (acc.n + v.w >= q), v.d2).otherwise(acc.d2).alias("d2")))
        return F.coalesce(F.sqrt(step.d2), F.lit(float("inf")))
    merged = border.select("pid", "first", "x", "w").join(lists, "pid").withColumn("kd", F.array(*[kth(q) for q in ks]))
    out = seen.where("done").select("pid", "first", "x", "w", "kd", "near").unionByName(merged.select("pid", "first", "x", "w", "kd", "near"))
    return written(out, "neighbors")


def rows_with(df: DataFrame, cols: Sequence[str], facts: DataFrame) -> DataFrame:
    """The rows of ``df`` with the columns of their point's ``facts`` (x, ...)."""
    filled, x = point(df, cols)
    place = "_x"
    given = df.columns
    rows = filled.select(*[F.col(c) for c in filled.columns if c not in cols], x.alias(place), *cols)
    return rows.join(facts.withColumnRenamed("x", place), place).select(*given, *[c for c in facts.columns if c != "x"])


def kth_neighbor_distance(df: DataFrame, id_col: str, cols: Sequence[str], ks: Sequence[int],
                          block_points: int = BLOCK_POINTS) -> DataFrame:
    """Rows of ``df`` with ``distance_<k>``: Euclidean distance to the k-th nearest row, the row
    itself counted (J4); k above the number of rows counts as that number."""
    points = weighted_points(df, id_col, cols)
    n = points.agg(F.coalesce(F.sum("w"), F.lit(1))).first()[0]
    near = nearest_neighbors(points, [min(k, n) for k in ks], block_points=block_points)
    facts = near.select("x", *[F.col("kd")[i].alias(f"distance_{k}") for i, k in enumerate(ks)])
    return rows_with(df, cols, facts)


def k_distance_curve(df: DataFrame, id_col: str, cols: Sequence[str], k: int, block_points: int = BLOCK_POINTS) -> DataFrame:
    """(position, distance): the distances to the k-th nearest row in ascending order (O5), one
    row per row of ``df``."""
    name = f"distance_{k}"
    rows = kth_neighbor_distance(df, id_col, cols, [k], block_points).select(F.col(id_col).alias("id"), F.col(name).alias("distance"))
    placed = global_position(rows, ["distance", "id"])
    return placed.select((F.col("position") + 1).alias("position"), "distance")


# --- neighbours within a radius (J5) ---------------------------------------------------

def _within(eps: float):
    def count(visitors: pa.Table, rows: pa.Table) -> pa.Table:
        x, y, w = _matrix(visitors["x"]), _matrix(rows["x"]), rows["w"].to_numpy() if rows.num_rows else np.zeros(0, int)
        n, step = np.zeros(len(x), np.int64), max(1, TABLE // max(1, len(y)))
        for at in range(0, len(x) if len(y) else 0, step):
            n[at:at + step] = (np.sqrt(_distances(x[at:at + step], y)) <= eps) @ w
        return pa.table({"pid": visitors["pid"].combine_chunks() if visitors.num_rows else pa.array([], pa.int64()), "n": pa.array(n)})
    return count


def neighbor_counts(df: DataFrame, id_col: str, cols: Sequence[str], eps: float, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Rows of ``df`` with ``n_neighbors``: rows within ``eps`` (inclusive, itself counted). A
    block that lies wholly within eps of a point adds its count; a point visits the others
    that its ball touches."""
    ship_package(df.sparkSession)
    points = weighted_points(df, id_col, cols)
    tree = blocks_of(points, block_points)
    placed = written(in_blocks(points, tree), "blocks")
    d = tree.low.shape[1]
    bounds = [f(F.col("x")[i]) for f in (F.min, F.max) for i in range(d)]
    low, high, count = np.full((len(tree.low), d), np.inf), np.full((len(tree.low), d), -np.inf), np.zeros(len(tree.low), np.int64)
    for r in placed.groupBy("block").agg(F.sum("w"), *bounds).collect():        # a row per block: bounded
        low[r[0]], high[r[0]], count[r[0]] = r[2:2 + d], r[2 + d:], r[1]
    held = df.sparkSession.sparkContext.broadcast((tree._replace(low=low, high=high), count))

    def look(batches):
        tree, count = held.value
        for batch in batches:
            x = _matrix(batch.column("x"))
            who, leaf = tree.reached(x, np.full(len(x), eps))
            far = np.maximum(np.abs(x[who] - tree.low[leaf]), np.abs(x[who] - tree.high[leaf]))
            whole = np.sqrt((far * far).sum(axis=1)) <= eps
            sure = np.bincount(who[whole], weights=count[leaf[whole]].astype(float), minlength=len(x)).astype(np.int64)
            who, leaf = who[~whole], leaf[~whole].astype(np.int32)
            order = np.argsort(who, kind="stable")
            at = np.r_[0, np.cumsum(np.bincount(who, minlength=len(x)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("pid"), batch.column("x"), pa.array(sure), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(leaf[order]))],
                names=["pid", "x", "n", "visits"])

    looked = placed.select("pid", "x").mapInArrow(look, "pid long, x array<double>, n long, visits array<int>")
    calls = looked.select("pid", "x", F.explode("visits").alias("block"))
    met = calls.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_within(eps), "pid long, n long")
    total = looked.select("pid", "n").unionByName(met).groupBy("pid").agg(F.sum("n").alias("n_neighbors"))
    return rows_with(df, cols, points.select("pid", "x").join(total, "pid").select("x", "n_neighbors"))
