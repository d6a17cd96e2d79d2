"""Graphs stored by contig and place, and loci read from them with pruned scans.

Every node has an anchor: its first place on the reference walk of its contig or, off the reference, the smallest
anchor among the nodes it was reached from, link by link. Tables are partitioned by contig and by bin of the anchor, so
that a locus reads the bins around it only. Context is then expanded along the links (`weighted_reach`); while it
touches the outermost bins that were read, more are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkloom.model import Graph
from walkloom.operators.iterate import weighted_reach
from walkloom.sharedfs import materialize, release


def anchors(nodes: DataFrame, links: DataFrame, placed: DataFrame) -> DataFrame:
    """(locus_id, id, contig, anchor) from placed(locus_id, id, contig, anchor): one round for each link that the
    farthest node is off the reference. Nodes that no reference node reaches are left out: no locus holds them."""
    adj = links.select("locus_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    adj = adj.unionByName(adj.select("locus_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached = front = materialize(placed, "anchors")
    while True:
        least = F.min(F.struct("contig", "anchor")).alias("x")
        step = front.withColumnRenamed("id", "a").join(adj, ["locus_id", "a"]).groupBy("locus_id", F.col("b").alias("id")).agg(least)
        front = materialize(step.select("locus_id", "id", "x.contig", "x.anchor").join(reached, ["locus_id", "id"], "left_anti"), "anchors")
        if not front.limit(1).count():
            break
        reached = reached.unionByName(front)
    return nodes.select("locus_id", "id").join(reached, ["locus_id", "id"])


def store_graph(g: Graph, refs: DataFrame, path: str, bin_bp: int = 1 << 16) -> None:
    """Write g below path. refs(locus_id, walk_pos, sample, contig): its reference walks; of those of one contig, the
    first places the nodes, and each can be asked for."""
    first = refs.groupBy("locus_id", "contig").agg(F.min("walk_pos").alias("walk_pos"))
    lengths = g.segments.select("locus_id", "id", F.col("length").alias("_length"))
    along = Window.partitionBy("locus_id", "walk_pos").orderBy("step_pos").rowsBetween(Window.unboundedPreceding, -1)
    steps = g.steps.join(lengths, ["locus_id", "id"], "left").withColumn("offset", F.coalesce(F.sum(F.coalesce("_length", F.lit(0))).over(along), F.lit(0)))
    steps = materialize(steps.withColumn("step_end", F.col("offset") + F.coalesce("_length", F.lit(0))).drop("_length"), "placed-steps")
    visits = steps.join(first, ["locus_id", "walk_pos"]).groupBy("locus_id", "id").agg(F.min(F.struct("walk_pos", "offset", "contig")).alias("x"))
    placed = visits.select("locus_id", "id", "x.contig", F.col("x.offset").cast("long").alias("anchor"))
    place = materialize(anchors(g.segments, g.links, placed).withColumn("bin", F.floor(F.col("anchor") / bin_bp)), "places")
    spark = refs.sparkSession

    def save(df: DataFrame, name: str, *order: str) -> None:
        keyed = df.repartitionByRange("contig", "bin", *order).sortWithinPartitions("contig", "bin", *order)
        keyed.write.partitionBy("contig", "bin").parquet(f"{path}/{name}")

    save(g.segments.join(place.select("locus_id", "id", "anchor", "contig", "bin"), ["locus_id", "id"]), "segments", "seg_pos")
    at = lambda side: place.select("locus_id", F.col("id").alias(f"{side}_id"), "contig", F.col("bin").alias(f"{side}_bin"))
    # A link lies in the bins of both its ends.
    links = g.links.join(at("from"), ["locus_id", "from_id"]).join(at("to").drop("contig"), ["locus_id", "to_id"])
    save(links.withColumn("bin", F.explode(F.array_distinct(F.array("from_bin", "to_bin")))).drop("from_bin", "to_bin"), "links", "link_pos")
    save(steps.join(place.select("locus_id", "id", "contig", "bin"), ["locus_id", "id"]), "steps", "walk_pos", "step_pos")
    g.walks.write.parquet(f"{path}/walks")
    lines = refs.select("locus_id", "walk_pos", "sample", "contig")
    on = steps.select("locus_id", "walk_pos", "step_pos", "id", "offset", "step_end").join(lines, ["locus_id", "walk_pos"])
    base = g.walks.select("locus_id", "walk_pos", F.coalesce("start", F.lit(0)).alias("base"))
    on = on.join(base, ["locus_id", "walk_pos"], "left").withColumns({"ref_start": F.coalesce("base", F.lit(0)) + F.col("offset"), "ref_end": F.coalesce("base", F.lit(0)) + F.col("step_end")})
    on = on.join(place.select("locus_id", "id", F.col("bin").alias("node_bin")), ["locus_id", "id"], "left")
    on = on.select("locus_id", "id", "sample", "contig", "ref_start", "ref_end", "node_bin")
    on.repartitionByRange("contig", "ref_start").sortWithinPartitions("contig", "ref_start").write.partitionBy("contig").parquet(f"{path}/reference")
    spark.createDataFrame([(bin_bp,)], "bin_bp long").coalesce(1).write.parquet(f"{path}/settings")


def reference_nodes(spark: SparkSession, path: str, sample: str, contig: str, start: int, end: int) -> DataFrame:
    """The reference nodes that overlap [start, end): contig prunes folders, places are pushed into the scan."""
    ref = spark.read.parquet(f"{path}/reference")
    return ref.filter((F.col("contig") == contig) & (F.col("sample") == sample) & (F.col("ref_start") < end) & (F.col("ref_end") > start))


def read_locus(spark: SparkSession, path: str, sample: str, contig: str, start: int, end: int, context: int = 100, locus: str | None = None) -> Graph:
    """The subgraph of a locus and its context, inside the contig: nodes within `context` bases, the links among them, and every run of
    steps that a walk takes through them, as walks of their own (in order of walk and run; start and end by offset).
    A locus without reference nodes gives empty tables. The bins read are doubled until the context lies inside them."""
    core = materialize(reference_nodes(spark, path, sample, contig, start, end).select("locus_id", "id", "node_bin").distinct(), "locus-core")
    low, high = core.agg(F.min("node_bin"), F.max("node_bin")).first()
    bin_bp = spark.read.parquet(f"{path}/settings").first()[0]
    name = locus or f"{sample}.{contig}.{start}-{end}"
    margin = 1 + context // bin_bp
    here = (F.col("contig") == contig) & (F.col("bin") == -2)
    nodes = core.select("locus_id", "id", F.lit(0).cast("long").alias("dist")).limit(0)
    while low is not None:
        here = (F.col("contig") == contig) & F.col("bin").between(low - margin, high + margin)
        links = spark.read.parquet(f"{path}/links").filter(here)
        adj = links.select("locus_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
        adj = adj.unionByName(adj.select("locus_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        read = spark.read.parquet(f"{path}/segments").filter(here).select("locus_id", "id", "length", "bin")
        nodes = weighted_reach(adj, core.select("locus_id", "id", F.lit(0).cast("long").alias("dist")), read, context)
        # Whatever lies in a bin that was not read, or in an outermost one, may have links that were not.
        edge = nodes.join(read.select("locus_id", "id", "bin"), ["locus_id", "id"], "left").filter(F.col("bin").isNull() | ~F.col("bin").between(low - margin + 1, high + margin - 1))
        spread = spark.read.parquet(f"{path}/links").filter(F.col("contig") == contig).agg(F.min("bin"), F.max("bin")).first()
        if not edge.limit(1).count() or (spread[0] is not None and low - margin < spread[0] and high + margin > spread[1]):
            break
        release(nodes)
        margin *= 2
    inside = nodes.select("locus_id", "id")
    segments = spark.read.parquet(f"{path}/segments").filter(here).join(inside, ["locus_id", "id"], "left_semi").drop("contig", "bin", "anchor")
    links = spark.read.parquet(f"{path}/links").filter(here).drop("contig", "bin").dropDuplicates(["locus_id", "link_pos"])
    for side in ("from_id", "to_id"):
        links = links.join(inside.withColumnRenamed("id", side), ["locus_id", side], "left_semi")
    steps = spark.read.parquet(f"{path}/steps").filter(here).join(inside, ["locus_id", "id"], "left_semi")
    walk = Window.partitionBy("locus_id", "walk_pos").orderBy("step_pos")
    steps = steps.withColumn("run", F.col("step_pos") - F.row_number().over(walk))
    runs = steps.groupBy("locus_id", "walk_pos", "run").agg(F.min("step_pos").alias("from_step"), F.min("offset").alias("lo"), F.max("step_end").alias("hi"))
    # A run's number keeps the order of walks and of runs in a walk.
    runs = runs.withColumn("new_pos", F.row_number().over(Window.partitionBy("locus_id").orderBy("walk_pos", "from_step")).cast("long") - 1)
    runs = materialize(runs, "locus-runs")
    walks = spark.read.parquet(f"{path}/walks").join(runs.select("locus_id", "walk_pos", "new_pos", "lo", "hi"), ["locus_id", "walk_pos"])
    base = F.coalesce("start", F.lit(0))
    walks = walks.withColumns({"start": base + F.col("lo"), "end": base + F.col("hi"), "walk_pos": F.col("new_pos")}).drop("lo", "hi", "new_pos")
    steps = steps.join(runs.select("locus_id", "walk_pos", "run", "new_pos", "from_step"), ["locus_id", "walk_pos", "run"])
    steps = steps.select("locus_id", F.col("new_pos").alias("walk_pos"), (F.col("step_pos") - F.col("from_step")).alias("step_pos"), "id", "rev")
    headers = spark.createDataFrame([(name, [sample])], "locus_id string, reference_samples array<string>")
    named = lambda df: df.withColumn("locus_id", F.lit(name))
    return Graph(named(segments), named(links), named(walks), named(steps), headers)
