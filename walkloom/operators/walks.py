"""Walks as ordered data: consecutive pairs, run collapse, structure, projections, haplotype lists and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.functions.sequence import trace_key
from walkloom.model import Graph

WALK = ["locus_id", "walk_pos"]


def along(*more: str) -> Window:
    return Window.partitionBy(*WALK, *more).orderBy("step_pos")


def consecutive_pairs(steps: DataFrame) -> DataFrame:
    """steps with next_id (and next_rev where orientation is known), last step left out."""
    out = steps.withColumn("next_id", F.lead("id").over(along()))
    if "rev" in steps.columns:
        out = out.withColumn("next_rev", F.lead("rev").over(along()))
    return out.filter("next_id is not null")


def walk_structure(steps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct directed pairs (a, b), unordered pairs (a < b), and self-loops, as walks show them."""
    p = consecutive_pairs(steps).select("locus_id", F.col("id").alias("a"), F.col("next_id").alias("b"))
    loops = p.filter("a = b").select("locus_id", F.col("a").alias("id")).distinct()
    directed = p.filter("a <> b").distinct()
    return directed, directed.select("locus_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), loops


def link_structure(links: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(undirected adjacency in both directions, self-loops) of links whose both ends exist."""
    ids = segments.select("locus_id", "id")
    ok = links.join(ids.withColumnRenamed("id", "from_id"), ["locus_id", "from_id"], "left_semi").join(ids.withColumnRenamed("id", "to_id"), ["locus_id", "to_id"], "left_semi")
    one = ok.filter("from_id <> to_id").select("locus_id", F.explode(F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b")))).alias("e"))
    return one.select("locus_id", "e.a", "e.b").distinct(), ok.filter("from_id = to_id").select("locus_id", F.col("from_id").alias("id")).distinct()


def displayed_ids(segments: DataFrame) -> DataFrame:
    """(locus_id, id, shown): a segment shows itself and its members; of several, the last counts."""
    own = segments.select("locus_id", "id", F.col("id").alias("shown"), (F.col("seg_pos") * 2).alias("o"))
    inside = segments.select("locus_id", F.explode("members").alias("id"), F.col("id").alias("shown"), (F.col("seg_pos") * 2 + 1).alias("o"))
    return own.unionByName(inside).groupBy("locus_id", "id").agg(F.max_by("shown", "o").alias("shown"))


def collapse_runs(steps: DataFrame, mapping: DataFrame, to: str = "shown") -> DataFrame:
    """Steps mapped to other ids: unmapped steps go first, then a step equal to the one before it."""
    m = steps.join(mapping.select("locus_id", "id", F.col(to).alias("_to")), ["locus_id", "id"]).withColumn("_before", F.lag("_to").over(along()))
    m = m.filter(~F.col("_to").eqNullSafe(F.col("_before")))
    return m.drop("id", "_before").withColumnRenamed("_to", "id")


def walk_name() -> Column:
    return F.concat_ws("#", "sample", "hap", "seq_id")


def real_walks(walks: DataFrame) -> DataFrame:
    return walks.filter("kind <> 'synthetic'")


def named_walks(walks: DataFrame) -> DataFrame:
    """The haplotype list: first walk of each name; anonymous ones numbered in order."""
    w = real_walks(walks).withColumn("name", walk_name())
    w = w.withColumn("_n", F.row_number().over(Window.partitionBy("locus_id", "name").orderBy("walk_pos"))).filter("_n = 1").drop("_n")
    anonymous = F.coalesce(F.col("sample"), F.lit("")).isin("", "_gbwt_ref", "unknown")
    number = F.sum(F.when(anonymous, 1).otherwise(0)).over(Window.partitionBy("locus_id").orderBy("walk_pos"))
    return w.withColumn("label", F.when(anonymous, F.concat(F.lit("Walk "), number.cast("string"))).otherwise(F.concat(F.col("sample"), F.lit(" hap "), F.col("hap").cast("string"))))


def search_walks(walks: DataFrame, text: str) -> DataFrame:
    hay = F.lower(F.concat(F.col("sample"), F.lit(" "), F.col("seq_id"), F.lit(" hap "), F.col("hap").cast("string")))
    return walks.filter(hay.contains(text.lower()))


def find_walk(walks: DataFrame, sample: str, hap: int, seq_id: str) -> DataFrame:
    w = real_walks(walks).filter((F.col("sample") == sample) & (F.col("hap") == hap) & (F.col("seq_id") == seq_id))
    first = w.groupBy("locus_id").agg(F.min("walk_pos").alias("walk_pos"))
    return w.join(first, WALK, "left_semi")


def samples_in_order(walks: DataFrame) -> DataFrame:
    return real_walks(walks).groupBy("locus_id", "sample").agg(F.min("walk_pos").alias("first_pos"))


def walks_through(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(locus_id, walk_pos) of walks that visit any of nodes(locus_id, id)."""
    return steps.join(nodes.select("locus_id", "id"), ["locus_id", "id"], "left_semi").select(*WALK).distinct()


def walks_taking(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(locus_id, walk_pos) of walks that step between the ends of any of edges(locus_id, a, b), either way."""
    p = consecutive_pairs(steps).select(*WALK, F.least("id", "next_id").alias("a"), F.greatest("id", "next_id").alias("b"))
    e = edges.select("locus_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return p.join(e, ["locus_id", "a", "b"], "left_semi").select(*WALK).distinct()


def node_walk_index(steps: DataFrame) -> DataFrame:
    """(locus_id, id, walk_pos), each once: node to walks."""
    return steps.select("locus_id", "id", "walk_pos").distinct()


def edge_walk_index(steps: DataFrame) -> DataFrame:
    return consecutive_pairs(steps).filter("id <> next_id").select("locus_id", F.least("id", "next_id").alias("a"), F.greatest("id", "next_id").alias("b"), "walk_pos").distinct()


def walk_ids(steps: DataFrame) -> DataFrame:
    """(locus_id, walk_pos, ids): one walk's ids in order."""
    return steps.groupBy(*WALK).agg(F.transform(F.array_sort(F.collect_list(F.struct("step_pos", "id"))), lambda s: s["id"]).alias("ids"))


def distinct_traces(steps: DataFrame, both_ways: bool = True) -> DataFrame:
    """(locus_id, trace, walks, first_pos): equal projected walks as one; both_ways joins a trace and its reverse."""
    key = trace_key(F.col("ids")) if both_ways else F.array_join("ids", ">")
    return walk_ids(steps).withColumn("trace", key).groupBy("locus_id", "trace").agg(F.count("*").alias("walks"), F.min("walk_pos").alias("first_pos"))


def trace_overlays(steps: DataFrame, targets: DataFrame, most: int = 48) -> DataFrame:
    """Distinct traces of the target walks, first seen first, at most `most` a locus."""
    t = distinct_traces(steps.join(targets, WALK, "left_semi"), both_ways=False)
    n = F.row_number().over(Window.partitionBy("locus_id").orderBy("first_pos"))
    return t.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def overlay_target(hover_skip=None, hover_node=None, selected_skip=None, selected_node=None):
    """Which of the four choices decides what is traced."""
    return next(((k, v) for k, v in (("skip", hover_skip), ("node", hover_node), ("skip", selected_skip), ("node", selected_node)) if v is not None), None)


def endpoints(steps: DataFrame) -> DataFrame:
    """(locus_id, walk_pos, first_id, last_id)."""
    return steps.groupBy(*WALK).agg(F.min_by("id", "step_pos").alias("first_id"), F.max_by("id", "step_pos").alias("last_id"))


def endpoints_at(g: Graph, node: str) -> DataFrame:
    """Walks that start or end at a node: role and span."""
    e = endpoints(g.steps).join(real_walks(g.walks), WALK)
    role = F.when((F.col("first_id") == node) & (F.col("last_id") == node), "both").when(F.col("first_id") == node, "start").when(F.col("last_id") == node, "end")
    return e.withColumn("role", role).filter("role is not null").select(*WALK, "sample", "hap", "seq_id", "role", "start", "end")


def strand_votes(steps: DataFrame, ref_index: DataFrame) -> DataFrame:
    """(locus_id, walk_pos, up, down, reversed): a walk is reversed if its steps between reference nodes go down more
    often than up. ref_index(locus_id, id, idx) has first visits."""
    on_ref = steps.join(ref_index.select("locus_id", "id", "idx"), ["locus_id", "id"]).withColumn("before", F.lag("idx").over(along()))
    return on_ref.groupBy(*WALK).agg(F.count_if(F.col("idx") > F.col("before")).alias("up"), F.count_if(F.col("idx") < F.col("before")).alias("down")).withColumn("reversed", F.col("down") > F.col("up"))


def layout_paths(g: Graph, reference_sample: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, path steps, reference segment ids) of the layout view: dangling links and unknown steps dropped,
    paths named sample#hap#seq; reference ids from all walks of the sample, else from the first walk."""
    ids = g.segments.select("locus_id", "id")
    links = g.links.join(ids.withColumnRenamed("id", "from_id"), ["locus_id", "from_id"], "left_semi").join(ids.withColumnRenamed("id", "to_id"), ["locus_id", "to_id"], "left_semi")
    paths = g.steps.join(ids, ["locus_id", "id"], "left_semi").join(g.walks.select(*WALK, "sample", walk_name().alias("path")), WALK)
    mine = g.walks.filter(F.col("sample") == reference_sample).select(*WALK) if reference_sample else g.walks.limit(0).select(*WALK)
    first = g.walks.join(mine, "locus_id", "left_anti").groupBy("locus_id").agg(F.min("walk_pos").alias("walk_pos"))
    ref = paths.join(mine.unionByName(first), WALK, "left_semi").select("locus_id", "id").distinct()
    return links, paths.drop("sample"), ref
