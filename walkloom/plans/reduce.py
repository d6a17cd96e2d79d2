"""The reduce query: collapse, unchop and count, for any number of loci at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.model import STAT_TAGS, Graph
from walkloom.operators.collapse import apply_collapse, plan_collapse, reroute
from walkloom.operators.coverage import reduced_coverage
from walkloom.operators.unchop import unchop
from walkloom.operators.walks import WALK, collapse_runs
from walkloom.sharedfs import materialize


@dataclass(frozen=True)
class Reduced:
    stats: DataFrame  # locus_id and STAT_TAGS
    chains: DataFrame  # locus_id, out_idx, out_id, members, seq, length, wc, ws, we
    links: DataFrame  # locus_id, link_pos, from_idx, from_rev, to_idx, to_rev, wc
    reference: DataFrame  # locus_id, step_pos, id (out_idx), rev
    spans: DataFrame
    headers: DataFrame
    reference_walks: DataFrame


def locus_totals(walks: DataFrame) -> DataFrame:
    """(locus_id, TW, WR, NS): haplotypes by weight, records, samples."""
    return walks.groupBy("locus_id").agg(F.sum("weight").alias("TW"), F.count("*").alias("WR"), F.count_distinct("sample").alias("NS"))


def named_reference(g: Graph) -> DataFrame:
    """(locus_id, walk_pos): the first walk with coordinates whose sample the header lists; loci without one are
    absent."""
    listed = g.headers.select("locus_id", F.explode("reference_samples").alias("sample")).distinct()
    ok = g.walks.filter("kind = 'W' and start is not null and end is not null").join(listed, ["locus_id", "sample"], "left_semi")
    return ok.groupBy("locus_id").agg(F.min("walk_pos").alias("walk_pos"))


def reduce_graph(g: Graph, max_variant: int = 50) -> Reduced:
    steps = materialize(g.steps, "reduce-steps")
    segments, links, walks = (materialize(t, "reduce-in") for t in (g.segments.select("locus_id", "id", "seg_pos", "seq", "length"), g.links.drop("wc"), g.walks))
    g = g.with_(walks=walks)
    ref = materialize(named_reference(g), "reduce-ref")
    ref_steps = steps.join(ref, WALK, "left_semi")
    ref_steps = ref_steps.select("locus_id", F.col("step_pos").alias("idx"), "id", "rev")
    index = ref_steps.groupBy("locus_id", "id").agg(F.min("idx").alias("idx"))
    spans = materialize(plan_collapse(segments, links, steps, ref, max_variant), "reduce-spans")
    kept_segments, kept_links = apply_collapse(segments, links, spans, index)
    members, chains, out_links = unchop(kept_segments, kept_links)
    to_out = members.select("locus_id", "id", F.col("out_idx").cast("string").alias("out"))

    others = walks.join(ref, WALK, "left_anti")
    led = reroute(steps.join(ref, WALK, "left_anti"), spans, ref_steps, index)
    mapped = collapse_runs(led, to_out, "out").withColumn("id", F.col("id").cast("long"))
    node, edge, totals = reduced_coverage(mapped, others)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    chains = chains.join(node.withColumnRenamed("id", "out_idx"), ["locus_id", "out_idx"], "left").select("locus_id", "out_idx", "out_id", "members", "seq", "length", zero("wc"), zero("ws"), zero("we"))
    chains = materialize(chains, "reduce-chains")
    out_links = out_links.withColumn("a", F.least("from_idx", "to_idx")).withColumn("b", F.greatest("from_idx", "to_idx")).join(edge, ["locus_id", "a", "b"], "left").select("locus_id", "link_pos", "from_idx", "from_rev", "to_idx", "to_rev", zero("wc"))
    out_links = materialize(out_links, "reduce-links")
    mine = steps.join(ref, WALK, "left_semi")
    reference = collapse_runs(mine, to_out, "out").select("locus_id", "step_pos", F.col("id").cast("long").alias("id"), "rev")

    loci = segments.select("locus_id").union(walks.select("locus_id")).distinct()
    parts = (
        segments.groupBy("locus_id").agg(F.count("*").alias("SB")), chains.groupBy("locus_id").agg(F.count("*").alias("SA"), F.sum("length").alias("TS"), F.sum(F.size("members") - 1).alias("UM")),
        links.groupBy("locus_id").agg(F.count("*").alias("LB")), out_links.groupBy("locus_id").agg(F.count("*").alias("LA")),
        spans.groupBy("locus_id").agg(F.count("*").alias("ST"), F.sum("nodes").alias("NR"), F.sum("singles").alias("SN"), F.sum("bases").alias("BR")),
        locus_totals(walks), totals.withColumnRenamed("non_ref_walks", "NW"),
    )
    stats = loci
    for p in parts:
        stats = stats.join(p, "locus_id", "left")
    stats = stats.select("locus_id", *[F.coalesce(t, F.lit(0)).cast("long").alias(t) for t in STAT_TAGS])
    heads = walks.join(ref, WALK, "left_semi")
    return Reduced(stats, chains, out_links, reference, spans, g.headers, heads)


def reduced_lines(r: Reduced) -> DataFrame:
    """(locus_id, line_pos, value): the reduced graph as text, records in the order H, X, S, L, W."""
    tab = "\t"
    tag = lambda t, c: F.concat(F.lit(f"{t}:i:"), c.cast("string"))
    names = r.chains.select("locus_id", F.col("out_idx").alias("i"), "out_id")
    base = 1 << 60
    head = r.stats.join(r.headers, "locus_id", "left")
    h = head.select("locus_id", F.lit(0).cast("long").alias("line_pos"), F.concat_ws(tab, F.lit("H"), F.lit("VN:Z:1.1"), F.when(F.size(F.coalesce("reference_samples", F.array().cast("array<string>"))) > 0, F.concat(F.lit("RS:Z:"), F.array_join("reference_samples", " ")))).alias("value"))
    x = r.stats.select("locus_id", F.lit(1).cast("long").alias("line_pos"), F.concat_ws(tab, F.lit("X"), *[tag(t, F.col(t)) for t in STAT_TAGS]).alias("value"))
    s = r.chains.select("locus_id", (F.col("out_idx") + 2).alias("line_pos"), F.concat_ws(tab, F.lit("S"), "out_id", "seq", tag("WC", F.col("wc")), F.when(F.col("ws") > 0, tag("WS", F.col("ws"))), F.when(F.col("we") > 0, tag("WE", F.col("we"))), F.when(F.size("members") > 1, F.concat(F.lit("MB:Z:"), F.array_join("members", ",")))).alias("value"))
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    a, b = names.select("locus_id", F.col("i").alias("from_idx"), F.col("out_id").alias("a")), names.select("locus_id", F.col("i").alias("to_idx"), F.col("out_id").alias("b"))
    l = r.links.join(a, ["locus_id", "from_idx"]).join(b, ["locus_id", "to_idx"]).select("locus_id", (F.col("link_pos") + base).alias("line_pos"), F.concat_ws(tab, F.lit("L"), "a", sign("from_rev"), "b", sign("to_rev"), F.lit("0M"), tag("WC", F.col("wc"))).alias("value"))  # noqa: E741
    walk = r.reference.join(names.withColumnRenamed("i", "id"), ["locus_id", "id"]).groupBy("locus_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_pos", F.concat(F.when(F.col("rev"), "<").otherwise(">"), F.col("out_id")).alias("t")))), lambda v: v["t"]), "").alias("walk"))
    w = r.reference_walks.join(walk, "locus_id", "left").select("locus_id", F.lit((1 << 62)).alias("line_pos"), F.concat_ws(tab, F.lit("W"), "sample", F.col("hap").cast("string"), "seq_id", F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("walk", F.lit(""))).alias("value"))
    out = h
    for part in (x, s, l, w):
        out = out.unionByName(part)
    return out
