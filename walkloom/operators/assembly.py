"""Assembly statistics of a graph without walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkloom.model import Graph
from walkloom.operators.bubbles import link_ends
from walkloom.operators.iterate import components


def valid_links(g: Graph) -> DataFrame:
    ids = g.segments.select("locus_id", "id")
    return g.links.join(ids.withColumnRenamed("id", "from_id"), ["locus_id", "from_id"], "left_semi").join(ids.withColumnRenamed("id", "to_id"), ["locus_id", "to_id"], "left_semi")


def n50(lengths: DataFrame, key: list[str], length: str = "length") -> DataFrame:
    """(key.., n50): the first length, longest first, at which half the total is reached."""
    w = Window.partitionBy(*key)
    run = F.sum(length).over(w.orderBy(F.col(length).desc()))  # equal lengths together reach it at one length
    x = lengths.withColumn("_run", run).withColumn("_all", F.sum(length).over(w))
    return x.groupBy(*key).agg(F.coalesce(F.max(F.when(2 * F.col("_run") >= F.col("_all"), F.col(length))), F.lit(0)).cast("long").alias("n50"))


def depth_summary(segments: DataFrame) -> DataFrame:
    """(locus_id, depth struct<min, median, max, covered, unit>): the lower median, the last unit seen."""
    d = segments.filter("depth is not null").groupBy("locus_id").agg(F.min("depth").alias("min"), F.expr("percentile_disc(0.5) within group (order by depth)").alias("median"), F.max("depth").alias("max"), F.count("*").alias("covered"), F.max_by("depth_unit", "seg_pos").alias("unit"))
    return d.select("locus_id", F.struct("min", "median", "max", "covered", "unit").alias("depth"))


def end_usage(g: Graph) -> DataFrame:
    """(locus_id, id, sides): how many sides of a segment a valid link touches."""
    used = link_ends(valid_links(g)).distinct().groupBy("locus_id", "id").agg(F.count("*").alias("n"))
    return g.segments.select("locus_id", "id").join(used, ["locus_id", "id"], "left").select("locus_id", "id", F.coalesce("n", F.lit(0)).alias("sides"))


def component_sizes(g: Graph) -> DataFrame:
    links = valid_links(g).select("locus_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return components(g.segments.select("locus_id", "id"), links).groupBy("locus_id", "component").agg(F.count("*").alias("size"))


def assembly_stats(g: Graph) -> DataFrame:
    """One row per locus."""
    base = g.segments.groupBy("locus_id").agg(F.count("*").alias("segments"), F.sum("length").alias("total_bp"), F.max("length").alias("longest_bp"))
    links = valid_links(g).groupBy("locus_id").agg(F.count("*").alias("links"), F.count_if(F.col("from_id") == F.col("to_id")).alias("self_loops"))
    comp = component_sizes(g).groupBy("locus_id").agg(F.count("*").alias("components"), F.max("size").alias("largest"))
    ends = end_usage(g).groupBy("locus_id").agg(F.count_if(F.col("sides") == 1).alias("dead_ends"), F.count_if(F.col("sides") == 0).alias("isolated"))
    out = base.join(n50(g.segments, ["locus_id"]), "locus_id").join(links, "locus_id", "left").join(comp, "locus_id").join(ends, "locus_id").join(depth_summary(g.segments), "locus_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("locus_id", "segments", "total_bp", "longest_bp", "n50", zero("links"), zero("self_loops"), "components", (F.col("largest") / F.col("segments")).alias("largest_fraction"), "dead_ends", "isolated", "depth")


def segment_report(g: Graph, segment: str) -> DataFrame:
    """One segment with its tags and its neighbours, itself left out."""
    near = g.links.filter((F.col("from_id") == segment) | (F.col("to_id") == segment)).select("locus_id", F.when(F.col("from_id") == segment, F.col("to_id")).otherwise(F.col("from_id")).alias("n")).filter(F.col("n") != segment)
    near = near.groupBy("locus_id").agg(F.sort_array(F.collect_set("n")).alias("neighbours"))
    s = g.segments.filter(F.col("id") == segment).select("locus_id", "id", "length", "depth", "depth_unit", "sr", "sn", "so")
    return s.join(near, "locus_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))
