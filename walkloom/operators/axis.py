"""The reference axis: where each node lies along the reference walk, and what touches it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.model import Graph


def reference_axis(g: Graph, ref: DataFrame, keep: str = "first") -> DataFrame:
    """(locus_id, id, idx, rev, start, end, visits): offsets run over every step of the reference walk, repeats
    included; of a node visited twice the first (or last) visit counts."""
    s = g.steps.join(ref.select("locus_id", "walk_pos"), ["locus_id", "walk_pos"]).join(g.segments.select("locus_id", "id", "length"), ["locus_id", "id"], "left").withColumn("length", F.coalesce("length", F.lit(0)))
    along = Window.partitionBy("locus_id").orderBy("step_pos")
    s = s.withColumn("end", F.sum("length").over(along)).withColumn("start", F.col("end") - F.col("length")).withColumn("idx", F.row_number().over(along) - 1)
    pick = F.min_by if keep == "first" else F.max_by
    one = s.groupBy("locus_id", "id").agg(pick(F.struct("idx", "rev", "start", "end"), "step_pos").alias("x"), F.count("*").alias("visits"))
    return one.select("locus_id", "id", F.col("x.idx").cast("long").alias("idx"), "x.rev", "x.start", "x.end", "visits")


def reference_length(g: Graph, ref: DataFrame) -> DataFrame:
    """(locus_id, ref_len): at least 1."""
    s = g.steps.join(ref.select("locus_id", "walk_pos"), ["locus_id", "walk_pos"]).join(g.segments.select("locus_id", "id", "length"), ["locus_id", "id"], "left")
    return ref.select("locus_id").join(s.groupBy("locus_id").agg(F.sum(F.coalesce("length", F.lit(0))).alias("n")), "locus_id", "left").select("locus_id", F.greatest(F.lit(1), F.coalesce("n", F.lit(0))).cast("long").alias("ref_len"))


def with_both_ends(links: DataFrame, axis: DataFrame) -> DataFrame:
    """Links with a_start, a_end (their from side) and b_start, b_end (to side); null off the reference."""
    a = axis.select("locus_id", F.col("id").alias("from_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = axis.select("locus_id", F.col("id").alias("to_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return links.join(a, ["locus_id", "from_id"], "left").join(b, ["locus_id", "to_id"], "left")


def attach_points(links: DataFrame, axis: DataFrame) -> DataFrame:
    """(locus_id, id, bp): where a link between a reference node and another touches the reference. Leaving a node
    forward touches its end, entering it forward its start."""
    x = with_both_ends(links, axis)
    leaving = F.when(F.col("from_rev"), F.col("a_start")).otherwise(F.col("a_end"))
    entering = F.when(F.col("to_rev"), F.col("b_end")).otherwise(F.col("b_start"))
    on_a, on_b = F.col("a_start").isNotNull(), F.col("b_start").isNotNull()
    return x.filter(on_a != on_b).select("locus_id", F.when(on_a, F.col("to_id")).otherwise(F.col("from_id")).alias("id"), F.when(on_a, leaving).otherwise(entering).alias("bp"))


def skip_edges(links: DataFrame, axis: DataFrame) -> DataFrame:
    """Links between reference nodes that jump over reference bases: with left_bp, right_bp, gap."""
    x = with_both_ends(links, axis).filter("a_start is not null and b_start is not null")
    a_first = F.col("a_start") <= F.col("b_start")
    left = F.when(a_first, F.col("a_end")).otherwise(F.col("b_end"))
    right = F.when(a_first, F.col("b_start")).otherwise(F.col("a_start"))
    return x.withColumn("left_bp", left).withColumn("right_bp", right).withColumn("gap", right - left).filter("gap > 0")


def locus_window(axis: DataFrame) -> DataFrame:
    return axis.groupBy("locus_id").agg(F.min("start").alias("window_start"), F.max("end").alias("window_end"))


def order_breaks(axis: DataFrame, share: float = 0.005, least: int = 4) -> DataFrame:
    """Quality check: places in index order where the start drops by more than max(least, share of the span)."""
    w = Window.partitionBy("locus_id").orderBy("idx")
    span = locus_window(axis)
    x = axis.withColumn("drop", F.lag("start").over(w) - F.col("start")).join(span, "locus_id")
    limit = F.greatest(F.lit(float(least)), (F.col("window_end") - F.col("window_start")) * share)
    return x.filter(F.col("drop") > limit).select("locus_id", "id", "idx", "drop")


def genomic_to_x(points: DataFrame, anchors: DataFrame, bp: str = "bp") -> DataFrame:
    """Piecewise-linear map of points(locus_id, bp) through anchors(locus_id, anchor_bp, anchor_x); beyond the outer
    anchors the nearest piece is carried on. Each point meets its piece by an as-of scan of one ordered union."""
    w = Window.partitionBy("locus_id").orderBy("anchor_bp")
    a = anchors.withColumn("next_bp", F.lead("anchor_bp").over(w)).withColumn("next_x", F.lead("anchor_x").over(w))
    a = a.withColumn("first", F.row_number().over(w) == 1).filter("next_bp is not null")
    # The first piece also serves what lies before it.
    piece = F.struct("anchor_bp", "anchor_x", "next_bp", "next_x")
    at = F.when(F.col("first"), F.lit(-(1 << 62))).otherwise(F.col("anchor_bp"))
    rows = a.select("locus_id", at.alias("at"), F.lit(0).alias("kind"), piece.alias("piece")).unionByName(points.select("locus_id", F.col(bp).alias("at"), F.lit(1).alias("kind")), allowMissingColumns=True)
    scan = Window.partitionBy("locus_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("piece", F.last("piece", ignorenulls=True).over(scan)).filter("kind = 1")
    x = F.col("piece.anchor_x") + (F.col("at") - F.col("piece.anchor_bp")) / (F.col("piece.next_bp") - F.col("piece.anchor_bp")) * (F.col("piece.next_x") - F.col("piece.anchor_x"))
    return rows.select("locus_id", F.col("at").alias(bp), x.alias("x"))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
