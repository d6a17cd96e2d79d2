"""Tables that the views draw from: previews, highlights, overlays, gene tracks, node colours, report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkloom.functions.display import endpoint_label, members_preview, mode_colour, node_ratio, sequence_preview, size_text, steps_preview, walk_label
from walkloom.model import Graph
from walkloom.operators.genes import representative_transcripts
from walkloom.operators.walks import WALK, collapse_runs, displayed_ids, endpoints_at, find_walk, real_walks


def _first(df: DataFrame, order: str, most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("locus_id").orderBy(order))
    return df.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def preview_walks(g: Graph, most: int = 25) -> DataFrame:
    """The first walks of each locus with the number of steps and the first of them."""
    w = _first(g.walks, "walk_pos", most)
    head = g.steps.join(w.select(*WALK), WALK, "left_semi").groupBy(*WALK).agg(F.count("*").alias("steps"), F.array_sort(F.collect_list(F.when(F.col("step_pos") <= 6, F.struct("step_pos", "id", "rev")))).alias("s"))
    path = steps_preview(F.transform("s", lambda x: F.struct(x["id"].alias("id"), x["rev"].alias("rev"))))
    return w.join(head, WALK, "left").select("locus_id", "walk_pos", "sample", "hap", "seq_id", "start", "end", F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce(path, F.lit("")).alias("path"))


def preview_segments(g: Graph, most: int = 25) -> DataFrame:
    s = _first(g.segments, "seg_pos", most)
    return s.select("locus_id", "seg_pos", "id", "length", F.coalesce("wc", F.lit(0)).alias("walks"), F.when(F.col("members").isNull(), "—").otherwise(members_preview(F.col("members"))).alias("members"), sequence_preview(F.col("seq")).alias("seq"))


def preview_links(g: Graph, most: int = 25) -> DataFrame:
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    return _first(g.links, "link_pos", most).select("locus_id", "link_pos", F.concat(sign("from_rev"), F.col("from_id")).alias("from"), F.concat(sign("to_rev"), F.col("to_id")).alias("to"))


def exit_highlight(steps: DataFrame, traced: DataFrame | None = None, bubble: DataFrame | None = None) -> DataFrame:
    """(locus_id, id), each once: the members of the bubble(locus_id, members) in question or, without one, every node
    that the traced(locus_id, walk_pos) walks visit."""
    if bubble is not None:
        return bubble.select("locus_id", F.explode("members").alias("id")).distinct()
    if traced is None:
        return steps.select("locus_id", "id").limit(0)
    return steps.join(traced.select(*WALK), WALK, "left_semi").select("locus_id", "id").distinct()


def overlays(hovered: DataFrame | None, pinned: DataFrame, from_alignment: DataFrame) -> DataFrame:
    """What is traced, as a bag: what is hovered, or else what is pinned; always with the rows picked in the alignment."""
    return (hovered if hovered is not None else pinned).unionByName(from_alignment)


def straightened_path(g: Graph, sample: str, hap: int, seq_id: str) -> DataFrame:
    """One named walk projected to the displayed segments: (locus_id, walk_pos, step_pos, rev, id)."""
    walk = find_walk(g.walks, sample, hap, seq_id)
    return collapse_runs(g.steps.join(walk.select(*WALK), WALK, "left_semi"), displayed_ids(g.segments)).select(*WALK, "step_pos", "rev", "id")


def labelled_endpoints(g: Graph, node: str) -> DataFrame:
    """(locus_id, walk_pos, label, length, role) of the walks that start or end at a node."""
    e = endpoints_at(g, node)
    return e.select(*WALK, endpoint_label(F.col("sample"), F.col("hap")).alias("label"), (F.col("end") - F.col("start")).alias("length"), "role")


def labelled_walks(g: Graph) -> DataFrame:
    """(locus_id, walk_pos, label): walks of two steps or more, the first of each name; those of unknown samples are
    numbered in order."""
    long = g.steps.groupBy(*WALK).agg(F.count("*").alias("n")).filter("n >= 2").select(*WALK)
    w = real_walks(g.walks).join(long, WALK, "left_semi")
    w = w.withColumn("_n", F.row_number().over(Window.partitionBy("locus_id", "sample", "hap", "seq_id").orderBy("walk_pos"))).filter("_n = 1")
    number = F.count_if(F.col("sample") == "unknown").over(Window.partitionBy("locus_id").orderBy("walk_pos"))
    label = F.when(F.col("sample") == "unknown", F.concat(F.lit("Walk "), number.cast("string"))).otherwise(F.col("sample"))
    return w.select(*WALK, label.alias("label"), walk_label(F.col("sample"), F.col("hap")).alias("row_label"))


def gene_track(transcripts: DataFrame, window: DataFrame) -> DataFrame:
    """The representative transcripts(locus_id, contig, ..) that overlap window(locus_id, contig, window_start,
    window_end), in order of place: one of each symbol, numbered `place`."""
    inside = transcripts.join(window, ["locus_id", "contig"]).filter("start < window_end and end > window_start").drop("window_start", "window_end")
    one = representative_transcripts(inside, ["locus_id", "symbol"], "pos")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("locus_id").orderBy("start", "end", "pos")) - 1)


def normalisers(segments: DataFrame, backbone: DataFrame, coverage: DataFrame, bubbles: DataFrame) -> DataFrame:
    """(locus_id, max_segment_length, max_coverage, max_bubble_longest): the longest node off the backbone(locus_id, id),
    the most walks of coverage(locus_id, coverage), the longest path of bubbles(locus_id, longest); 0 where none."""
    off = segments.join(backbone.select("locus_id", "id"), ["locus_id", "id"], "left_anti").groupBy("locus_id").agg(F.max("length").alias("max_segment_length"))
    cov = coverage.groupBy("locus_id").agg(F.max("coverage").alias("max_coverage"))
    big = bubbles.groupBy("locus_id").agg(F.max("longest").alias("max_bubble_longest"))
    every = segments.select("locus_id").distinct().join(off, "locus_id", "left").join(cov, "locus_id", "left").join(big, "locus_id", "left")
    return every.select("locus_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("max_segment_length", "max_coverage", "max_bubble_longest")])


def node_colours(nodes: DataFrame, backbone: DataFrame, most: DataFrame, mode: str, theme: str = "dark", tone: str = "#334155") -> DataFrame:
    """(locus_id, id, ratio, colour) of nodes(locus_id, id, value), most(locus_id, most): backbone nodes have its tone."""
    on = backbone.select("locus_id", "id", F.lit(True).alias("fixed"))
    x = nodes.join(most, "locus_id", "left").join(on, ["locus_id", "id"], "left")
    ratio = F.when(F.col("fixed").isNull(), node_ratio(mode, F.coalesce("value", F.lit(0)), F.coalesce("most", F.lit(0))))
    return x.select("locus_id", "id", ratio.alias("ratio"), F.when(F.col("fixed"), tone).otherwise(mode_colour(mode, ratio, theme)).alias("colour"))


def report_rows(complexity: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """(locus_id, place, item, value): the rows of a query's report in order. Raw counts, sites and merges are rows of
    simplified graphs only; what was fetched(locus_id, bytes, blocks) comes first where it is known."""
    num = lambda c: F.format_number(F.col(c).cast("decimal(38,0)"), 0)
    x = complexity
    if fetched is not None:
        x = x.join(fetched, "locus_id", "left")
    else:
        x = x.withColumns({"bytes": F.lit(None).cast("long"), "blocks": F.lit(None).cast("long")})
    reduced = lambda c: F.when(F.col("simplified"), num(c))
    bases = lambda c: F.coalesce(F.concat(num(c), F.lit(" bp")), F.lit(""))
    rows = [
        ("fetched", F.concat(size_text(F.col("bytes")), F.lit(" in "), F.col("blocks").cast("string"), F.lit(" blocks"))), ("nodes", num("nodes")), ("raw nodes", reduced("nodes_before")),
        ("links", num("links")), ("raw links", reduced("links_before")), ("walks", num("walks")), ("sites collapsed", reduced("variant_sites")), ("reference span", bases("reference_path_bp")),
        ("chains merged", reduced("unchop_merges")), ("sequence shown", bases("total_sequence_bp")),
    ]
    items = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("item"), v.alias("value")) for i, (n, v) in enumerate(rows)])
    return x.select("locus_id", F.explode(F.filter(items, lambda r: r["value"].isNotNull())).alias("r")).select("locus_id", "r.place", "r.item", "r.value")


def components_in_order(components: DataFrame) -> DataFrame:
    """components(locus_id, id, component) with members in code point order, and a number for each component."""
    c = components.groupBy("locus_id", "component").agg(F.count("*").alias("size"))
    c = c.withColumn("number", F.row_number().over(Window.partitionBy("locus_id").orderBy("component")) - 1)
    return components.join(c, ["locus_id", "component"]).withColumn("place", F.row_number().over(Window.partitionBy("locus_id", "component").orderBy("id")) - 1)


def backbones_in_order(backbones: DataFrame, segments: DataFrame) -> DataFrame:
    """backbones(locus_id, component, id, ..) with the total length of each component's backbone and its rank, longest
    first, then by component."""
    total = backbones.join(segments.select("locus_id", "id", "length"), ["locus_id", "id"]).groupBy("locus_id", "component").agg(F.sum("length").alias("total_bp"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("locus_id").orderBy(F.col("total_bp").desc(), "component")) - 1)
