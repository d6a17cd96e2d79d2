"""Connected components by alternating star contraction (large star, small star).

Every round is two aggregations with map-side combine and two equi-joins; no group is gathered anywhere and
nothing but a checksum per round reaches the driver. A hub's rows are spread by AQE's skew-join splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.sharedfs import materialize, release


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node reachable; only nodes other than their root appear.

    Nulls and self-loops are ignored; repeated edges are harmless; an empty input gives an empty result.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "cc-edges")
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(now)), "cc-round")
        release(now)
        now = after
        # Done when every node points at one other, which points nowhere.
        ends = now.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        busy = ends.groupBy("a").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 or (out = 1 and into > 0)")
        if not busy.limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
