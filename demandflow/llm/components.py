"""Connected components of an edge table, entirely in Spark.

Alternates large-star and small-star steps until the edge set is stable: every
node then points at the smallest node of its component. Each step is a grouped
minimum (pre-aggregated before the shuffle) and a join between two stored tables,
which adaptive execution splits when one node holds many edges. Rounds grow with
the logarithm of a component's size, and each round's edges are written to the
shared folder, so a lost executor costs no more than the round in work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandflow.llm.common import stored


def _stars(directed: DataFrame) -> DataFrame:
    """(u, v) with the smallest of u and its neighbours as ``m``."""
    least = stored(directed.groupBy("u").agg(F.min("v").alias("m")), "star")
    return directed.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), both long and not null, any direction, repeats and loops
    allowed. Returns (node, root) for every node with an edge to another node;
    ``root`` is the smallest node reachable. No edges: no rows."""
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _summary(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        small = _stars(large)  # every edge already points from the larger node to the smaller
        e = stored(small.select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = _summary(e)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
