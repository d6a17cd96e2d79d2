"""Four coverages that answer different questions; none stands in for another.

reduced: haplotypes per node, edge and end, by weight, of the walks given (the reference left out by the caller);
layout:  tagged counts if any node of the locus has one, else distinct walks per node;
bubble:  distinct walks per node, every passage per edge;
event:   every passage per node and directed edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.model import Graph
from walkloom.operators.walks import WALK, consecutive_pairs, endpoints, real_walks


def reduced_coverage(steps: DataFrame, walks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """steps (mapped to output nodes) and walks(locus_id, walk_pos, weight) ->
    node (locus_id, id, wc, ws, we), edge (locus_id, a, b, wc), totals (locus_id, non_ref_walks). A walk without
    steps still counts in the total. Duplicates go before the weight is joined, so one exchange by walk serves all."""
    weight = walks.select(*WALK, "weight")
    once = steps.select(*WALK, "id").distinct().join(weight, WALK)
    node = once.groupBy("locus_id", "id").agg(F.sum("weight").alias("wc"))
    ends = endpoints(steps).join(weight, WALK)
    ws = ends.groupBy("locus_id", F.col("first_id").alias("id")).agg(F.sum("weight").alias("ws"))
    we = ends.groupBy("locus_id", F.col("last_id").alias("id")).agg(F.sum("weight").alias("we"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    node = node.join(ws, ["locus_id", "id"], "left").join(we, ["locus_id", "id"], "left").select("locus_id", "id", "wc", zero("ws"), zero("we"))
    pairs = consecutive_pairs(steps).filter("id <> next_id").select(*WALK, F.least("id", "next_id").alias("a"), F.greatest("id", "next_id").alias("b")).distinct()
    edge = pairs.join(weight, WALK).groupBy("locus_id", "a", "b").agg(F.sum("weight").alias("wc"))
    return node, edge, walks.groupBy("locus_id").agg(F.sum("weight").alias("non_ref_walks"))


def layout_coverage(g: Graph, backbone_names: DataFrame | None = None) -> DataFrame:
    """(locus_id, id, coverage). Without tags, walks whose name is that of a backbone are left out."""
    tagged = g.segments.groupBy("locus_id").agg(F.max(F.col("wc").isNotNull()).alias("tagged"))
    walks = g.walks.withColumn("name", F.concat_ws("#", "sample", "hap", "seq_id"))
    if backbone_names is not None:
        walks = walks.join(backbone_names.select("locus_id", "name"), ["locus_id", "name"], "left_anti")
    seen = g.steps.join(walks.select(*WALK), WALK, "left_semi").select(*WALK, "id").distinct().groupBy("locus_id", "id").agg(F.count("*").alias("n"))
    s = g.segments.select("locus_id", "id", "wc").join(tagged, "locus_id").join(seen, ["locus_id", "id"], "left")
    return s.select("locus_id", "id", F.when(F.col("tagged"), F.coalesce("wc", F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("coverage"))


def bubble_coverage(g: Graph) -> tuple[DataFrame, DataFrame]:
    """node (locus_id, id, cov): distinct walks, the reference too; edge (locus_id, a, b, cov): every passage, loops
    too. Synthetic walks are left out."""
    steps = g.steps.join(real_walks(g.walks).select(*WALK), WALK, "left_semi")
    node = steps.select(*WALK, "id").distinct().groupBy("locus_id", "id").agg(F.count("*").alias("cov"))
    edge = consecutive_pairs(steps).groupBy("locus_id", F.least("id", "next_id").alias("a"), F.greatest("id", "next_id").alias("b")).agg(F.count("*").alias("cov"))
    return node, edge


def event_coverage(steps: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node (locus_id, id, cov) and directed edge (locus_id, a, b, cov): every passage of every walk but the
    reference; loops are no edges."""
    other = steps.join(ref.select(*WALK), WALK, "left_anti")
    node = other.groupBy("locus_id", "id").agg(F.count("*").alias("cov"))
    edge = consecutive_pairs(other).filter("id <> next_id").groupBy("locus_id", F.col("id").alias("a"), F.col("next_id").alias("b")).agg(F.count("*").alias("cov"))
    return node, edge


def busiest_alt(g: Graph, axis: DataFrame) -> DataFrame:
    """(locus_id, id): the non-reference node with most walks, the first of equals; else the middle reference node."""
    node, _ = bubble_coverage(g)
    alt = g.segments.join(axis.select("locus_id", "id"), ["locus_id", "id"], "left_anti").join(node, ["locus_id", "id"]).groupBy("locus_id").agg(F.max_by("id", F.struct("cov", (-F.col("seg_pos")).alias("p"))).alias("alt"))
    mid = axis.groupBy("locus_id").agg(F.element_at(F.array_sort(F.collect_list(F.struct("idx", "id"))), (F.floor(F.count("*") / 2) + 1).cast("int"))["id"].alias("mid"))
    return mid.join(alt, "locus_id", "full").select("locus_id", F.coalesce("alt", "mid").alias("id"))


def maxima(events: DataFrame, coverage: DataFrame) -> DataFrame:
    """Normalisers of the views: never below 1."""
    a = events.groupBy("locus_id").agg(F.greatest(F.lit(1), F.max(F.greatest("len", "skipped"))).alias("max_len"))
    b = coverage.groupBy("locus_id").agg(F.greatest(F.lit(1), F.max("coverage")).alias("max_coverage"))
    return b.join(a, "locus_id", "left")
