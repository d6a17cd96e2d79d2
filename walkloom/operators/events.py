"""Non-reference events: alternative nodes and deletions, placed on the reference axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.functions.sequence import CLASS_CODES, CLASS_LABELS, event_class, event_size, mapped
from walkloom.model import Graph
from walkloom.operators.axis import reference_axis, skip_edges
from walkloom.operators.coverage import event_coverage
from walkloom.operators.iterate import nearest_by_rounds
from walkloom.sharedfs import materialize


def nonref_events(g: Graph, ref: DataFrame, min_len: int = 0, search: int = 8) -> DataFrame:
    """(locus_id, id, len, left_bp, right_bp, skipped, net, cov, kind, pos): a node between reference neighbours, or
    up to `search` hops from the nearest; a link that jumps over reference bases. Of a node visited twice by the
    reference the last visit counts. Reduced loci take tagged counts."""
    axis = materialize(reference_axis(g, ref, keep="last"), "event-axis")
    node_cov, edge_cov = event_coverage(g.steps, ref)
    reduced = g.stats.select("locus_id", F.lit(True).alias("reduced")) if g.stats is not None else g.walks.limit(0).select("locus_id", F.lit(True).alias("reduced"))
    adj = g.links.select("locus_id", "link_pos", F.explode(F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b")))).alias("e")).groupBy("locus_id", "e.a", "e.b").agg(F.min("link_pos").alias("pos"))
    alt = g.segments.join(axis.select("locus_id", "id"), ["locus_id", "id"], "left_anti").select("locus_id", "id", "seg_pos", "length", "wc")
    side = axis.select("locus_id", F.col("id").alias("b"), "start", "end")
    near = alt.select("locus_id", F.col("id").alias("a")).join(adj, ["locus_id", "a"]).join(side, ["locus_id", "b"]).groupBy("locus_id", F.col("a").alias("id")).agg(
        F.count("*").alias("n"), F.min_by("end", F.struct("start", "pos")).alias("l"), F.max_by("start", F.struct("start", "pos")).alias("r"))
    near = near.select("locus_id", "id", F.when(F.col("n") == 1, F.col("l")).otherwise(F.least("l", "r")).alias("left_bp"), F.when(F.col("n") == 1, F.col("l")).otherwise(F.greatest("l", "r")).alias("right_bp"))
    lost = alt.join(near, ["locus_id", "id"], "left_anti")
    far = nearest_by_rounds(lost, adj, axis, search).join(side.withColumnRenamed("b", "target"), ["locus_id", "target"]).select("locus_id", "id", F.col("end").alias("left_bp"), F.col("end").alias("right_bp"))
    placed = alt.join(near.unionByName(far), ["locus_id", "id"]).join(node_cov, ["locus_id", "id"], "left").join(reduced, "locus_id", "left")
    cov = F.coalesce(F.when(F.col("reduced"), F.col("wc")).otherwise(F.col("cov")), F.lit(0)).cast("long")
    nodes = placed.select("locus_id", "id", F.col("length").alias("len"), "left_bp", "right_bp", cov.alias("cov"), F.lit(0).alias("kind"), F.col("seg_pos").alias("pos"))

    skips = skip_edges(g.links, axis)
    forward = F.col("a_start") <= F.col("b_start")
    skips = skips.withColumn("x", F.when(forward, F.col("from_id")).otherwise(F.col("to_id"))).withColumn("y", F.when(forward, F.col("to_id")).otherwise(F.col("from_id")))
    first = skips.groupBy("locus_id", "x", "y").agg(F.min_by(F.struct("from_id", "to_id", "left_bp", "right_bp", "wc", "link_pos"), "link_pos").alias("s")).select("locus_id", "s.*")
    one = edge_cov.groupBy("locus_id", F.least("a", "b").alias("ka"), F.greatest("a", "b").alias("kb")).agg(F.sum("cov").alias("cov"))
    first = first.withColumn("ka", F.least("from_id", "to_id")).withColumn("kb", F.greatest("from_id", "to_id")).join(one, ["locus_id", "ka", "kb"], "left").join(reduced, "locus_id", "left")
    cov = F.coalesce(F.when(F.col("reduced"), F.col("wc")).otherwise(F.col("cov")), F.lit(0)).cast("long")
    gone = first.select("locus_id", F.concat(F.lit("del:"), "from_id", F.lit(">"), "to_id").alias("id"), F.lit(0).cast("long").alias("len"), "left_bp", "right_bp", cov.alias("cov"), F.lit(1).alias("kind"), F.col("link_pos").alias("pos"))
    both = nodes.unionByName(gone).withColumn("skipped", F.greatest(F.lit(0), F.col("right_bp") - F.col("left_bp")).cast("long"))
    both = both.withColumn("net", F.col("len") - F.col("skipped"))
    return both.filter(event_size(F.col("len"), F.col("skipped")) > min_len)


def classified(events: DataFrame) -> DataFrame:
    c = event_class(F.col("len"), F.col("skipped"))
    return events.withColumn("class", c).withColumn("label", mapped(F.col("class"), CLASS_LABELS)).withColumn("code", mapped(F.col("class"), CLASS_CODES))


def in_order(events: DataFrame) -> DataFrame:
    return events.orderBy("locus_id", "left_bp", "kind", "pos")


def nonref_summary(g: Graph, ref: DataFrame, events: DataFrame) -> DataFrame:
    """(locus_id, ref_name, contig, genomic_start, total_non_ref, events, max_len)."""
    n = g.walks.groupBy("locus_id").agg(F.count("*").alias("walks"))
    named = g.walks.join(ref.select("locus_id", "walk_pos"), ["locus_id", "walk_pos"]).select("locus_id", F.concat_ws("#", "sample", "hap", "seq_id").alias("ref_name"), F.col("seq_id").alias("contig"), F.col("start").alias("genomic_start"))
    count = events.groupBy("locus_id").agg(F.count("*").alias("events"), F.max(F.greatest("len", "skipped")).alias("max_len"))
    out = named.join(n, "locus_id").join(count, "locus_id", "left")
    total = F.greatest(F.lit(1), F.col("walks") - 1)
    if g.stats is not None:
        out = out.join(g.stats.select("locus_id", "NW"), "locus_id", "left")
        total = F.greatest(F.lit(1), F.coalesce("NW", F.col("walks") - 1))
    return out.select("locus_id", "ref_name", "contig", "genomic_start", total.cast("long").alias("total_non_ref"), F.coalesce("events", F.lit(0)).alias("events"), F.greatest(F.lit(1), F.coalesce("max_len", F.lit(1))).cast("long").alias("max_len"))
