"""Interval joins as equi-joins on bins, and as-of joins as ordered scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width))


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_start: str, a_end: str, b_start: str, b_end: str, width: int) -> DataFrame:
    """Pairs of half-open intervals with a_start < b_end and b_start < a_end, each once: both sides are expanded to
    the bins they cover, and a pair counts in the bin of the larger start only."""
    x = a.withColumn("_bin", F.explode(_bins(F.col(a_start), F.col(a_end), width)))
    y = b.withColumn("_bin", F.explode(_bins(F.col(b_start), F.col(b_end), width)))
    met = x.join(y, [*on, "_bin"])
    keep = (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end)) & (F.col("_bin") == F.floor(F.greatest(F.col(a_start), F.col(b_start)) / width))
    return met.filter(keep).drop("_bin")


def spans_containing(queries: DataFrame, spans: DataFrame, on: list[str], lo: str = "lo", hi: str = "hi", l: str = "l", h: str = "h") -> DataFrame:  # noqa: E741
    """queries with `contained`: whether a span has l <= lo and hi <= h. One scan in order of place carries the
    largest h of the spans begun so far."""
    q = queries.withColumn("_kind", F.lit(1)).withColumn("_at", F.col(lo)).withColumn("_h", F.lit(None).cast("long"))
    s = spans.select(*on, F.lit(0).alias("_kind"), F.col(l).alias("_at"), F.col(h).alias("_h"))
    w = Window.partitionBy(*on).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = q.unionByName(s, allowMissingColumns=True).withColumn("_far", F.max("_h").over(w)).filter("_kind = 1")
    return both.withColumn("contained", F.coalesce(F.col("_far") >= F.col(hi), F.lit(False))).drop("_kind", "_at", "_h", "_far")


def point_in_block(points: DataFrame, blocks: DataFrame, on: list[str], bp: str = "bp", start: str = "col_start", size: str = "bp_len") -> DataFrame:
    """points with the last block that starts at or before them, if it reaches them (else null): `block`."""
    rest = [c for c in blocks.columns if c not in on]
    p = points.withColumn("_kind", F.lit(1)).withColumn("_at", F.col(bp))
    b = blocks.select(*on, F.lit(0).alias("_kind"), F.col(start).alias("_at"), F.struct(*rest).alias("block"))
    w = Window.partitionBy(*on).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(b, allowMissingColumns=True).withColumn("block", F.last("block", ignorenulls=True).over(w)).filter("_kind = 1")
    inside = F.col(bp) < F.col(f"block.{start}") + F.col(f"block.{size}")
    return both.withColumn("block", F.when(inside, F.col("block"))).drop("_kind", "_at")


def nearest_interval(points: DataFrame, intervals: DataFrame, on: list[str], center: str, start: str, end: str, pos: str) -> DataFrame:
    """For each point the interval whose middle is nearest; the first of equals."""
    d = F.abs((F.col(start) + F.col(end)) / 2 - F.col(center))
    w = Window.partitionBy(*on, center).orderBy(d, pos)
    return points.join(intervals, on).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
