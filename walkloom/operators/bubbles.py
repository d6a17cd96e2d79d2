"""Bubbles: components of non-reference nodes and jumps over the reference, as one catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.model import Graph
from walkloom.operators.axis import attach_points, reference_axis, skip_edges
from walkloom.operators.coverage import bubble_coverage
from walkloom.operators.iterate import components, path_extremes
from walkloom.sharedfs import materialize


def bubble_catalogue(g: Graph, ref: DataFrame) -> DataFrame:
    """(locus_id, entry_bp, exit_bp, ref_span, shortest, longest, node_count, node_ids, coverage, is_skip, link_from,
    link_to, pos). Components that do not touch the reference are left out. Ids that only links name extend a
    component with length 0. Path lengths are those of the forward links; with a cycle both are the whole length."""
    axis = materialize(reference_axis(g, ref), "bubble-axis")
    node_cov, edge_cov = bubble_coverage(g)
    on_ref = axis.select("locus_id", "id")
    off = g.links.join(on_ref.withColumnRenamed("id", "from_id"), ["locus_id", "from_id"], "left_anti").join(on_ref.withColumnRenamed("id", "to_id"), ["locus_id", "to_id"], "left_anti").select("locus_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    alt = g.segments.join(on_ref, ["locus_id", "id"], "left_anti")
    comp = materialize(components(alt.select("locus_id", "id"), off), "bubble-components")
    known = alt.select("locus_id", "id", "seg_pos", "length", "wc")
    member = comp.join(known, ["locus_id", "id"], "left").withColumn("length", F.coalesce("length", F.lit(0)).cast("long"))
    # A component found from no declared segment does not exist.
    live = member.groupBy("locus_id", "component").agg(F.min("seg_pos").alias("pos")).filter("pos is not null")
    touch = attach_points(g.links, axis).join(comp, ["locus_id", "id"]).groupBy("locus_id", "component").agg(F.min("bp").alias("entry_bp"), F.max("bp").alias("exit_bp"))
    cov = member.join(node_cov, ["locus_id", "id"], "left").withColumn("cov", F.coalesce("wc", "cov", F.lit(0)))
    facts = cov.groupBy("locus_id", "component").agg(F.sum("length").alias("total"), F.count("*").alias("node_count"), F.sort_array(F.collect_list("id")).alias("node_ids"), F.max("cov").alias("coverage"))
    inside = off.join(comp.select("locus_id", F.col("id").alias("a"), "component"), ["locus_id", "a"])
    ext = path_extremes(member.select("locus_id", "component", "id", "length"), inside, ["locus_id", "component"])
    k = ["locus_id", "component"]
    zero = F.lit(0).cast("long")
    nodes = live.join(touch, k).join(facts, k).join(ext, k).select(
        "locus_id", F.col("entry_bp").cast("long").alias("entry_bp"), F.col("exit_bp").cast("long").alias("exit_bp"), (F.col("exit_bp") - F.col("entry_bp")).cast("long").alias("ref_span"),
        F.coalesce("shortest", "total").cast("long").alias("shortest"), F.coalesce("longest", "total").cast("long").alias("longest"), "node_count", "node_ids", F.col("coverage").cast("long").alias("coverage"),
        F.lit(False).alias("is_skip"), F.lit("").alias("link_from"), F.lit("").alias("link_to"), "pos",
    )
    s = skip_edges(g.links, axis)
    first = s.groupBy("locus_id", "left_bp", "right_bp").agg(F.min_by(F.struct("from_id", "to_id", "wc", "link_pos"), "link_pos").alias("s")).select("locus_id", "left_bp", "right_bp", "s.*")
    first = first.withColumn("a", F.least("from_id", "to_id")).withColumn("b", F.greatest("from_id", "to_id")).join(edge_cov, ["locus_id", "a", "b"], "left")
    skips = first.select(
        "locus_id", F.col("left_bp").cast("long").alias("entry_bp"), F.col("right_bp").cast("long").alias("exit_bp"), (F.col("right_bp") - F.col("left_bp")).cast("long").alias("ref_span"),
        zero.alias("shortest"), zero.alias("longest"), zero.alias("node_count"), F.array().cast("array<string>").alias("node_ids"), F.coalesce("wc", "cov", F.lit(0)).cast("long").alias("coverage"),
        F.lit(True).alias("is_skip"), F.col("from_id").alias("link_from"), F.col("to_id").alias("link_to"), F.col("link_pos").alias("pos"),
    )
    return nodes.unionByName(skips)


def in_order(bubbles: DataFrame) -> DataFrame:
    return bubbles.orderBy("locus_id", "entry_bp", "is_skip", "pos")


def bubbles_of_nodes(bubbles: DataFrame) -> DataFrame:
    """(locus_id, id, entry_bp, exit_bp, longest): from a node to its bubble."""
    return bubbles.filter("not is_skip").select("locus_id", F.explode("node_ids").alias("id"), "entry_bp", "exit_bp", "longest")


def skip_view(bubbles: DataFrame, genomic_start: DataFrame) -> DataFrame:
    """Jumps in genomic coordinates; genomic_start(locus_id, genomic_start)."""
    b = bubbles.filter("is_skip").join(genomic_start, "locus_id")
    return b.select("locus_id", "link_from", "link_to", "ref_span", "coverage", (F.col("entry_bp") + F.col("genomic_start")).alias("start"), (F.col("exit_bp") + F.col("genomic_start")).alias("end"))


def leaving_bubbles(bubbles: DataFrame, exits: DataFrame) -> DataFrame:
    """Bubbles with a node among exits(locus_id, id)."""
    e = exits.groupBy("locus_id").agg(F.collect_set("id").alias("exits"))
    return bubbles.join(e, "locus_id").filter(F.arrays_overlap("node_ids", "exits")).drop("exits")


def exit_segments(links: DataFrame, segments: DataFrame, backbone: DataFrame) -> DataFrame:
    """(locus_id, id, side): ends of segments off the backbone that no link touches."""
    ends = segments.join(backbone.select("locus_id", "id"), ["locus_id", "id"], "left_anti").select("locus_id", "id", F.explode(F.array(F.lit("L"), F.lit("R"))).alias("side"))
    return ends.join(link_ends(links), ["locus_id", "id", "side"], "left_anti")


def link_ends(links: DataFrame) -> DataFrame:
    """(locus_id, id, side) once per link end: a link leaves its from node by the right side when forward, and enters
    its to node by the left side when forward."""
    out = F.struct(F.col("from_id").alias("id"), F.when(F.col("from_rev"), "L").otherwise("R").alias("side"))
    into = F.struct(F.col("to_id").alias("id"), F.when(F.col("to_rev"), "R").otherwise("L").alias("side"))
    return links.select("locus_id", F.explode(F.array(out, into)).alias("e")).select("locus_id", "e.id", "e.side")
