"""Loops over DataFrames: per-locus components, chains by pointer doubling, bounded search, layered paths.

Every round is written to the shared folder, which cuts lineage; a count or checksum per round is all that reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.operators.components import component_labels
from walkloom.sharedfs import materialize, release


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(locus_id, id), edges(locus_id, a, b) -> (locus_id, id, component): component is the smallest id in text
    order. Ids that only edges name are nodes too."""
    pack = lambda c: F.concat_ws("\x01", "locus_id", c)
    roots = component_labels(edges.select(pack("a").alias("a"), pack("b").alias("b")))
    every = nodes.select("locus_id", "id").unionByName(edges.select("locus_id", F.explode(F.array("a", "b")).alias("id"))).distinct()
    keyed = every.withColumn("node", pack("id"))
    return keyed.join(roots, "node", "left").select("locus_id", "id", F.element_at(F.split(F.coalesce("root", "node"), "\x01"), 2).alias("component"))


def chain_positions(nodes: DataFrame, nexts: DataFrame, max_rounds: int = 64) -> DataFrame:
    """nodes(locus_id, id), nexts(locus_id, x, y) with at most one y per x and x per y ->
    (locus_id, id, head, place): pointer doubling towards the head, log2(longest chain) rounds. Members of a pure
    cycle have no head; they come back as chains of their own (head = id, place = 0)."""
    back = nexts.select("locus_id", F.col("y").alias("id"), F.col("x").alias("up"))
    now = nodes.select("locus_id", "id").join(back, ["locus_id", "id"], "left").select("locus_id", "id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("up").isNull().alias("done"))
    now = materialize(now, "chain")
    before = -1
    for _ in range(max_rounds):
        left = now.filter("not done").count()
        if left == 0:
            break
        if left == before:  # every chain has a member next to those done: only cycles are left
            break
        before = left
        a, b = now.alias("a"), now.alias("b")
        jumped = a.join(b, (F.col("a.locus_id") == F.col("b.locus_id")) & (F.col("a.up") == F.col("b.id"))).select(
            F.col("a.locus_id").alias("locus_id"), F.col("a.id").alias("id"), F.when(F.col("a.done"), F.col("a.up")).otherwise(F.col("b.up")).alias("up"),
            F.when(F.col("a.done"), F.col("a.far")).otherwise(F.col("a.far") + F.col("b.far")).alias("far"), (F.col("a.done") | F.col("b.done")).alias("done"),
        )
        after = materialize(jumped, "chain")
        release(now)
        now = after
    return now.select("locus_id", "id", F.when(F.col("done"), F.col("up")).otherwise(F.col("id")).alias("head"), F.when(F.col("done"), F.col("far")).otherwise(F.lit(0)).alias("place"))


def nearest_by_rounds(starts: DataFrame, adj: DataFrame, targets: DataFrame, rounds: int = 8) -> DataFrame:
    """starts(locus_id, id), adj(locus_id, a, b, pos), targets(locus_id, id) -> (locus_id, id, target, hops): the
    target fewest hops away, at most `rounds`; of several the one whose link comes first, then the smaller id."""
    front = starts.select("locus_id", F.col("id").alias("start"), F.col("id").alias("at"))
    seen, found = front, None
    mark = targets.select("locus_id", F.col("id").alias("b"), F.lit(True).alias("hit"))
    for hop in range(1, rounds + 1):
        step = front.join(adj.withColumnRenamed("a", "at"), ["locus_id", "at"]).join(mark, ["locus_id", "b"], "left")
        hits = step.filter("hit").groupBy("locus_id", "start").agg(F.min(F.struct("pos", "b"))["b"].alias("target")).withColumn("hops", F.lit(hop))
        hits = materialize(hits, "bfs-hits")
        found = hits if found is None else found.unionByName(hits)
        step = step.filter("hit is null").select("locus_id", "start", F.col("b").alias("at")).distinct()
        front = step.join(hits, ["locus_id", "start"], "left_anti").join(seen, ["locus_id", "start", "at"], "left_anti")
        front = materialize(front, "bfs-front")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return found.withColumnRenamed("start", "id")


def bfs_hops(adj: DataFrame, sources: DataFrame, most: int = 1 << 30) -> DataFrame:
    """Unweighted distance and parent from sources(locus_id, id) over adj(locus_id, a, b)."""
    reached = materialize(sources.select("locus_id", "id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent")), "hops")
    front, hop = reached, 0
    while hop < most:
        hop += 1
        new = front.select("locus_id", F.col("id").alias("a")).join(adj, ["locus_id", "a"]).groupBy("locus_id", F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        new = new.join(reached, ["locus_id", "id"], "left_anti").select("locus_id", "id", F.lit(hop).alias("hops"), "parent")
        front = materialize(new, "hops")
        if not front.limit(1).count():
            break
        reached = reached.unionByName(front)
    return reached


def weighted_reach(adj: DataFrame, sources: DataFrame, lengths: DataFrame, most: float) -> DataFrame:
    """Context expansion: nodes whose nearest side lies within `most` bases of a source along the graph.
    sources(locus_id, id, dist); a node's neighbours are its length further off. The boundary rule: a node is in as
    soon as its near end is, whole."""
    best = materialize(sources.groupBy("locus_id", "id").agg(F.min("dist").alias("dist")), "reach")
    front = best
    while True:
        grown = front.join(lengths.select("locus_id", "id", "length"), ["locus_id", "id"]).select("locus_id", F.col("id").alias("a"), (F.col("dist") + F.when(F.col("dist") == 0, 0).otherwise(F.col("length"))).alias("dist"))
        new = grown.join(adj, ["locus_id", "a"]).groupBy("locus_id", F.col("b").alias("id")).agg((F.min("dist") + 1).alias("dist")).filter(F.col("dist") <= most)
        old = best.withColumnRenamed("dist", "had")
        front = materialize(new.join(old, ["locus_id", "id"], "left").filter("had is null or dist < had").drop("had"), "reach")
        if not front.limit(1).count():
            return best
        after = materialize(best.unionByName(front).groupBy("locus_id", "id").agg(F.min("dist").alias("dist")), "reach")
        release(best)
        best = after


def path_extremes(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Shortest and longest node-weighted path from a source to a sink of each group: nodes(key.., id, length),
    edges(key.., a, b) inside the group. A group with a cycle has no extremes (nulls). Kahn's layers: a node is done
    when all its predecessors are."""
    k = [*key, "id"]
    edges = materialize(edges.select(*key, "a", "b").distinct(), "dag-edges")
    indeg = edges.groupBy(*key, F.col("b").alias("id")).agg(F.count("*").alias("need"))
    state = nodes.select(*k, "length").join(indeg, k, "left").select(*k, "length", F.coalesce("need", F.lit(0)).alias("need"))
    state = materialize(state, "dag-nodes")
    done = materialize(state.filter("need = 0").select(*k, F.col("length").alias("lo"), F.col("length").alias("hi")), "dag-done")
    front, wait = done, state.filter("need > 0").withColumns({"got": F.lit(0).cast("long"), "lo": F.lit(None).cast("long"), "hi": F.lit(None).cast("long")})
    while True:
        came = front.withColumnRenamed("id", "a").join(edges, [*key, "a"]).groupBy(*key, F.col("b").alias("id")).agg(F.count("*").alias("n"), F.min("lo").alias("l"), F.max("hi").alias("h"))
        wait = wait.join(came, k, "left").select(*k, "length", "need", (F.col("got") + F.coalesce("n", F.lit(0))).alias("got"), F.least("lo", "l").alias("lo"), F.greatest("hi", "h").alias("hi"))
        wait = materialize(wait, "dag-wait")
        front = wait.filter("got = need").select(*k, (F.col("lo") + F.col("length")).alias("lo"), (F.col("hi") + F.col("length")).alias("hi"))
        if not front.limit(1).count():
            break
        front = materialize(front, "dag-front")
        done = done.unionByName(front)
        wait = wait.filter("got < need")
    sinks = done.join(edges.select(*key, F.col("a").alias("id")).distinct(), k, "left_anti").groupBy(*key).agg(F.min("lo").alias("shortest"), F.max("hi").alias("longest"))
    cyclic = wait.select(*key).distinct().withColumn("cyclic", F.lit(True))
    every = nodes.select(*key).distinct().join(sinks, key, "left").join(cyclic, key, "left")
    return every.select(*key, F.when(F.col("cyclic").isNull(), F.col("shortest")).alias("shortest"), F.when(F.col("cyclic").isNull(), F.col("longest")).alias("longest"))
