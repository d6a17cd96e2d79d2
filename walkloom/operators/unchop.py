"""Unchop: runs of nodes with nothing but one co-oriented step between them become one segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.functions.sequence import chain_step
from walkloom.operators.bubbles import link_ends
from walkloom.operators.iterate import chain_positions
from walkloom.sharedfs import materialize


def merge_steps(links: DataFrame) -> DataFrame:
    """(locus_id, x, y): the only link at x's right end is the only one at y's left end, and runs from x to y."""
    ends = link_ends(links).groupBy("locus_id", "id").agg(F.count_if(F.col("side") == "R").alias("r"), F.count_if(F.col("side") == "L").alias("l"))
    step = links.select("locus_id", chain_step(F.col("from_id"), F.col("from_rev"), F.col("to_id"), F.col("to_rev")).alias("s")).filter("s is not null").select("locus_id", "s.x", "s.y")
    a = ends.filter("r = 1").select("locus_id", F.col("id").alias("x"))
    b = ends.filter("l = 1").select("locus_id", F.col("id").alias("y"))
    return step.join(a, ["locus_id", "x"], "left_semi").join(b, ["locus_id", "y"], "left_semi")


def unchop(segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """segments(locus_id, id, seg_pos, seq, length), links(locus_id, link_pos, from_id, from_rev, to_id, to_rev) ->
    members (locus_id, id, out_idx, place, chain_size), chains (locus_id, out_idx, out_id, members, seq, length),
    links (locus_id, link_pos, from_idx, from_rev, to_idx, to_rev).

    Chains are numbered by their heads' place among the segments; if any member's sequence is empty, so is the
    chain's. Members of a pure cycle stay apart. Links inside a chain go; all others are kept, loops and repeats too.
    """
    at = chain_positions(segments, merge_steps(links)).withColumnRenamed("head", "h")
    heads = segments.select("locus_id", F.col("id").alias("h"), F.col("seg_pos").alias("h_pos"))
    member = materialize(at.join(heads, ["locus_id", "h"]).join(segments.select("locus_id", "id", "seq", "length"), ["locus_id", "id"]), "unchop-members")
    parts = F.array_sort(F.collect_list(F.struct("place", "id", "seq")))
    chains = member.groupBy("locus_id", "h", "h_pos").agg(parts.alias("p"), F.sum("length").alias("length"))
    ids = F.transform("p", lambda x: x["id"])
    seq = F.when(F.exists("p", lambda x: x["seq"] == ""), "").otherwise(F.array_join(F.transform("p", lambda x: x["seq"]), ""))
    out_id = F.when(F.size("p") > 1, F.concat(F.lit("u"), F.col("h"))).otherwise(F.col("h"))
    # The head's place in the text orders and names a chain; it need not be dense.
    chains = chains.select("locus_id", F.col("h_pos").alias("out_idx"), out_id.alias("out_id"), ids.alias("members"), seq.alias("seq"), F.col("length").cast("long").alias("length"))
    size = member.groupBy("locus_id", "h").agg(F.count("*").alias("chain_size"))
    members = member.join(size, ["locus_id", "h"]).select("locus_id", "id", F.col("h_pos").alias("out_idx"), "place", "chain_size")
    a = members.select("locus_id", F.col("id").alias("from_id"), F.col("out_idx").alias("from_idx"), F.col("place").alias("from_place"), "chain_size")
    b = members.select("locus_id", F.col("id").alias("to_id"), F.col("out_idx").alias("to_idx"), F.col("place").alias("to_place"))
    moved = links.join(a, ["locus_id", "from_id"]).join(b, ["locus_id", "to_id"])
    step = F.when((F.col("from_rev") == F.col("to_rev")) & (F.col("from_id") != F.col("to_id")), F.when(F.col("from_rev"), F.col("from_place") - F.col("to_place")).otherwise(F.col("to_place") - F.col("from_place")))
    inside = (F.col("from_idx") == F.col("to_idx")) & (F.col("chain_size") > 1) & F.coalesce(step == 1, F.lit(False))
    return members, chains, moved.filter(~inside).select("locus_id", "link_pos", "from_idx", "from_rev", "to_idx", "to_rev")
