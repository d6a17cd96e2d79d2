"""Alignment of the haplotypes that cross a window of the reference, node by node.

Only the reference's nodes of a locus are gathered (to clamp the window, a sequential fold); haplotypes are joined,
windowed and folded per walk.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkloom.functions.sequence import cell_signature, oriented
from walkloom.model import Graph, pick_alignment_reference
from walkloom.operators.walks import WALK, along, collapse_runs, displayed_ids, real_walks, walk_name
from walkloom.sharedfs import materialize


@dataclass(frozen=True)
class Alignment:
    window: DataFrame  # locus_id, selected, center, on_backbone, first_idx, last_idx, start, end, truncated
    blocks: DataFrame  # locus_id, block, seg_id, name, bp_len, col_start, is_backbone, is_selected, ref_start
    rows: DataFrame  # locus_id, row, key, sample, is_reference, multiplicity, through_selected, has_inversion, cells


def backbone_nodes(g: Graph, ref: DataFrame, shown: DataFrame) -> DataFrame:
    """(locus_id, id, idx, rev, ref_start, ref_end): first visits along the projected reference, from its start."""
    mine = collapse_runs(g.steps.join(ref, WALK, "left_semi"), shown).join(g.segments.select("locus_id", "id", "length"), ["locus_id", "id"], "left")
    first = g.walks.join(ref, WALK, "left_semi").select("locus_id", F.coalesce("start", F.lit(0)).alias("at"))
    w = Window.partitionBy("locus_id").orderBy("step_pos")
    mine = mine.join(first, "locus_id").withColumn("ref_end", F.col("at") + F.sum(F.coalesce("length", F.lit(0))).over(w)).withColumn("ref_start", F.col("ref_end") - F.coalesce("length", F.lit(0)))
    one = mine.groupBy("locus_id", "id").agg(F.min_by(F.struct("step_pos", "rev", "ref_start", "ref_end"), "step_pos").alias("x")).select("locus_id", "id", "x.*")
    return one.withColumn("idx", (F.row_number().over(Window.partitionBy("locus_id").orderBy("step_pos")) - 1).cast("long")).drop("step_pos")


def window_center(steps: DataFrame, backbone: DataFrame, selected: DataFrame, walk_order: DataFrame) -> DataFrame:
    """(locus_id, selected, center, on_backbone): the middle of the selected node, else of the nearest backbone nodes
    before and after it in the first walk that has either, else of the whole backbone."""
    own = selected.join(backbone.withColumnRenamed("id", "selected"), ["locus_id", "selected"]).select("locus_id", ((F.col("ref_start") + F.col("ref_end")) / 2).alias("own"))
    at = steps.join(walk_order, WALK, "left_semi").join(backbone.select("locus_id", "id", "ref_start", "ref_end"), ["locus_id", "id"], "left").join(selected, "locus_id")
    back, ahead = along().rowsBetween(Window.unboundedPreceding, -1), along().rowsBetween(1, Window.unboundedFollowing)
    at = at.withColumn("l", F.last("ref_end", ignorenulls=True).over(back)).withColumn("r", F.first("ref_start", ignorenulls=True).over(ahead)).filter(F.col("id") == F.col("selected"))
    at = at.groupBy("locus_id", "walk_pos").agg(F.min_by(F.struct("l", "r"), "step_pos").alias("x")).filter("x.l is not null or x.r is not null")
    both = F.when(F.col("x.l").isNull(), F.col("x.r").cast("double")).when(F.col("x.r").isNull(), F.col("x.l").cast("double")).otherwise((F.col("x.l") + F.col("x.r")) / 2)
    side = at.withColumn("side", both).groupBy("locus_id").agg(F.min_by("side", "walk_pos").alias("side"))
    whole = backbone.groupBy("locus_id").agg(((F.min_by("ref_start", "idx") + F.max_by("ref_end", "idx")) / 2).alias("whole"))
    out = selected.join(whole, "locus_id").join(own, "locus_id", "left").join(side, "locus_id", "left")
    return out.select("locus_id", "selected", F.coalesce("own", "side", "whole").alias("center"), F.col("own").isNotNull().alias("on_backbone"))


def clamp_window(backbone: DataFrame, center: DataFrame, window_bp: int, max_columns: int) -> DataFrame:
    """The backbone nodes within window_bp of the centre (the nearest one if there are none), less the nodes farther
    from the centre while they hold more than max_columns bases; of equals the right one goes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        c, lo, hi = pdf.center[0], pdf.center[0] - window_bp, pdf.center[0] + window_bp
        inside = pdf.index[(pdf.ref_end > lo) & (pdf.ref_start < hi)]
        a, b = (int(inside[0]), int(inside[-1])) if len(inside) else (int(((pdf.ref_start + pdf.ref_end) / 2 - c).abs().idxmin()),) * 2
        size = (pdf.ref_end - pdf.ref_start).tolist()
        total, cut = sum(size[a : b + 1]), False
        while b > a and total > max_columns:
            drop = a if c - pdf.ref_end[a] > pdf.ref_start[b] - c else b
            total, cut = total - size[drop], True
            a, b = (a + 1, b) if drop == a else (a, b - 1)
        return pd.DataFrame([(pdf.locus_id[0], pdf.selected[0], float(c), bool(pdf.on_backbone[0]), int(pdf.idx[a]), int(pdf.idx[b]), int(pdf.ref_start[a]), int(pdf.ref_end[b]), cut)], columns=["locus_id", "selected", "center", "on_backbone", "first_idx", "last_idx", "start", "end", "truncated"])

    rows = backbone.select("locus_id", "idx", "ref_start", "ref_end").join(center, "locus_id")
    return rows.groupBy("locus_id").applyInPandas(run, "locus_id string, selected string, center double, on_backbone boolean, first_idx long, last_idx long, start long, end long, truncated boolean")


def build_alignment(g: Graph, selected: DataFrame, reference_sample: str, window_bp: int, max_columns: int = 6000, max_rows: int = 300, max_alts: int = 24) -> Alignment:
    """selected(locus_id, id): the node each locus is looked at around."""
    g = Graph(*[materialize(t, "msa-in") for t in (g.segments, g.links, g.walks, g.steps)])
    shown = materialize(displayed_ids(g.segments), "msa-shown")
    ref = pick_alignment_reference(g, reference_sample)
    chosen = selected.join(shown, ["locus_id", "id"], "left").select("locus_id", F.coalesce("shown", "id").alias("selected"))
    chosen = chosen.join(g.segments.select("locus_id", F.col("id").alias("selected")), ["locus_id", "selected"], "left_semi")
    backbone = materialize(backbone_nodes(g, ref, shown), "msa-backbone")
    steps = materialize(collapse_runs(g.steps, shown), "msa-steps")
    # Haplotypes: neither synthetic nor the reference; the first walk of each name that matters.
    named = real_walks(g.walks).join(ref, WALK, "left_anti").select(*WALK, "sample", walk_name().alias("key"))

    def first_of_name(walks: DataFrame) -> DataFrame:
        return walks.withColumn("_n", F.row_number().over(Window.partitionBy("locus_id", "key").orderBy("walk_pos"))).filter("_n = 1").drop("_n")

    through = steps.join(chosen, "locus_id").filter(F.col("id") == F.col("selected")).select(*WALK).distinct()
    carriers = first_of_name(named.join(through, WALK, "left_semi"))
    window = materialize(clamp_window(backbone, window_center(steps, backbone, chosen, carriers), window_bp, max_columns), "msa-window")
    w = window.select("locus_id", "selected", "first_idx", "last_idx", "on_backbone")
    on = backbone.select("locus_id", "id", "idx", F.col("rev").alias("b_rev"), "ref_start")
    lengths = g.segments.select("locus_id", "id", "seq", "length")
    at = steps.join(w, "locus_id").join(on, ["locus_id", "id"], "left")
    in_window = F.coalesce(F.col("idx").between(F.col("first_idx"), F.col("last_idx")), F.lit(False))
    hits = at.withColumn("in_window", in_window).groupBy(*WALK).agg(F.max("in_window").alias("enters"), F.max(F.col("id") == F.col("selected")).alias("through")).filter("enters or through")
    walks = materialize(first_of_name(named.join(hits.select(*WALK, "through"), WALK)), "msa-walks")

    # Other nodes belong to the gap after the last window node their walk was at; a walk ends when, having been in the
    # window, it meets the backbone beyond it.
    seen = at.join(walks.select(*WALK), WALK, "left_semi").withColumn("in_window", in_window)
    past = along().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("gap", F.last(F.when(F.col("in_window"), F.col("idx") - F.col("first_idx")), ignorenulls=True).over(past))
    beyond = F.col("gap").isNotNull() & F.coalesce(F.col("idx") > F.col("last_idx"), F.lit(False))
    seen = seen.withColumn("over", F.max(beyond).over(past)).filter("not over and gap is not null and idx is null").join(lengths.select("locus_id", "id", "length"), ["locus_id", "id"]).filter("length > 0")
    alts = seen.groupBy("locus_id", "id").agg(F.min(F.struct("walk_pos", "step_pos", "gap")).alias("s")).select("locus_id", "id", "s.*")
    alts = alts.withColumn("n", F.row_number().over(Window.partitionBy("locus_id", "gap").orderBy("walk_pos", "step_pos"))).filter(F.col("n") <= max_alts).select("locus_id", "id", "gap", F.col("n").cast("long").alias("n"))
    mid = F.floor((F.col("last_idx") - F.col("first_idx")) / 2 + 0.5)
    lost = w.filter("not on_backbone").select("locus_id", F.col("selected").alias("id"), mid.alias("gap"), F.lit(0).cast("long").alias("n")).join(alts, ["locus_id", "id"], "left_anti")
    cols = on.join(w, "locus_id").filter(in_window).select("locus_id", "id", (F.col("idx") - F.col("first_idx")).alias("gap"), F.lit(-1).cast("long").alias("n"), "ref_start", "b_rev")
    blocks = cols.unionByName(alts.unionByName(lost), allowMissingColumns=True).join(lengths.select("locus_id", "id", F.col("length").alias("bp_len")), ["locus_id", "id"]).filter("bp_len > 0")
    order = Window.partitionBy("locus_id").orderBy("gap", "n")
    is_ref = F.col("n") == -1
    kind = F.row_number().over(Window.partitionBy("locus_id", is_ref).orderBy("gap", "n"))
    blocks = materialize(blocks.select(
        "locus_id", (F.row_number().over(order) - 1).alias("block"), F.col("id").alias("seg_id"), F.concat(F.when(is_ref, "R").otherwise("A"), kind.cast("string")).alias("name"), "bp_len",
        (F.sum("bp_len").over(order) - F.col("bp_len")).alias("col_start"), is_ref.alias("is_backbone"), "ref_start", "b_rev",
    ).join(w.select("locus_id", "selected"), "locus_id").withColumn("is_selected", F.col("seg_id") == F.col("selected")).drop("selected"), "msa-blocks")

    # Cells: a walk's first visit of a block counts; null is a gap, '' a node without bases.
    size = blocks.groupBy("locus_id").agg(F.count("*").cast("int").alias("n_blocks"))
    visits = steps.join(blocks.select("locus_id", F.col("seg_id").alias("id"), "block", "is_backbone", "b_rev"), ["locus_id", "id"]).join(lengths.select("locus_id", "id", "seq"), ["locus_id", "id"])
    first = visits.groupBy(*WALK, "block").agg(F.min_by(F.struct("rev", "seq", "is_backbone", "b_rev"), "step_pos").alias("v"))
    cell = F.when(F.col("v.seq") == "", "").otherwise(oriented(F.col("v.seq"), F.col("v.rev")))
    turned = F.col("v.is_backbone") & (F.col("v.rev") != F.col("v.b_rev"))
    cells = first.groupBy(*WALK).agg(F.map_from_entries(F.collect_list(F.struct("block", cell.alias("c")))).alias("m"), F.max(F.coalesce(turned, F.lit(False))).alias("inv"))

    def filled(rows: DataFrame) -> DataFrame:
        x = rows.join(size, "locus_id").join(cells, WALK, "left")
        m = F.coalesce("m", F.create_map().cast("map<int,string>"))
        return x.withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.element_at(m, i))).withColumn("inv", F.coalesce("inv", F.lit(False)))

    ref_row = filled(g.walks.join(ref, WALK, "left_semi").select(*WALK, "sample")).select("locus_id", F.lit(0).alias("row"), F.lit("#ref").alias("key"), "sample", F.lit(True).alias("is_reference"), F.lit(1).cast("long").alias("multiplicity"), F.lit(False).alias("through_selected"), F.col("inv").alias("has_inversion"), "cells")
    rows = filled(walks).withColumn("sig", cell_signature(F.col("cells")))
    rows = rows.groupBy("locus_id", "sig").agg(F.min_by(F.struct("walk_pos", "key", "sample", "through", "inv", "cells"), "walk_pos").alias("f"), F.count("*").alias("multiplicity"), F.max("through").alias("through_selected"))
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("locus_id").orderBy("f.walk_pos"))).filter(F.col("seen") <= max_rows - 1)
    place = F.row_number().over(Window.partitionBy("locus_id").orderBy(F.col("f.through").desc(), "f.walk_pos"))
    rows = rows.select("locus_id", place.alias("row"), "f.key", "f.sample", F.lit(False).alias("is_reference"), "multiplicity", "through_selected", F.col("f.inv").alias("has_inversion"), "f.cells")
    return Alignment(window, blocks, ref_row.unionByName(rows))


def truncated_rows(g: Graph, a: Alignment, walks_in_window: DataFrame) -> DataFrame:
    """(locus_id, truncated): walks of the window that no row stands for."""
    shown = a.rows.filter("not is_reference").groupBy("locus_id").agg(F.sum("multiplicity").alias("shown"))
    return walks_in_window.groupBy("locus_id").agg(F.count("*").alias("n")).join(shown, "locus_id", "left").select("locus_id", (F.col("n") - F.coalesce("shown", F.lit(0))).alias("truncated"))


def probe(a: Alignment, cells: DataFrame) -> DataFrame:
    """cells(locus_id, row, column) -> base at the column ('' visited without bases, null gap) and reference position."""
    from walkloom.operators.range_join import point_in_block

    p = point_in_block(cells.withColumnRenamed("column", "bp"), a.blocks.select("locus_id", "col_start", "bp_len", "block", "ref_start"), ["locus_id"]).join(a.rows.select("locus_id", "row", "cells"), ["locus_id", "row"])
    offset = F.col("bp") - F.col("block.col_start")
    cell = F.get("cells", F.col("block.block"))
    return p.select("locus_id", "row", F.col("bp").alias("column"), F.substr(cell, (offset + 1).cast("int"), F.lit(1)).alias("base"), (F.col("block.ref_start") + offset).alias("ref_pos"))


def total_haplotypes(a: Alignment) -> DataFrame:
    return a.rows.filter("not is_reference").groupBy("locus_id").agg(F.sum("multiplicity").alias("haplotypes"))
