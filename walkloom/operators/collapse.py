"""Collapse: small variant sites between two reference nodes are found, claimed left to right, and removed.

Sites are judged per locus on aggregates only (distinct walk edges, link adjacency, lengths), never on walks, so the
grouped map's input is bounded by the locus's nodes and edges. Everything else is joins and windows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from graphlib import CycleError, TopologicalSorter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkloom.operators.range_join import spans_containing
from walkloom.operators.walks import WALK, along, link_structure, strand_votes, walk_structure

CONE_NODES = 512


class SiteFinder:
    """The aggregates of one locus, and the test whether a reference node opens a small closed site."""

    def __init__(self, ref: list[str], lengths: dict[str, int], out: list, adj: list, loops: set[str], limit: int):
        self.ref, self.lengths, self.loops, self.limit = ref, lengths, loops, limit
        self.out, self.into, self.adj = defaultdict(set), defaultdict(set), defaultdict(set)
        for a, b in out:
            self.out[a].add(b)
            self.into[b].add(a)
        for a, b in adj:
            self.adj[a].add(b)
        self.place: dict[str, int] = {}
        for i, n in enumerate(ref):
            self.place.setdefault(n, i)

    def reachable(self, i: int) -> set[str] | None:
        """Nodes that a walk can be at after fewer than `limit` interior bases; None if an edge leads back before the
        entry or the search grows too wide."""
        entry = self.ref[i]
        near, queue = {entry: 0}, [(0, entry)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > near[u] or (u != entry and d >= self.limit):
                continue
            onward = d if u == entry else d + self.lengths.get(u, 0)
            for v in self.out[u]:
                if self.place.get(v, i) < i:
                    return None
                if onward < near.get(v, 1 << 62):
                    near[v] = onward
                    if len(near) > CONE_NODES:
                        return None
                    heapq.heappush(queue, (onward, v))
        return set(near)

    def between(self, entry: str, leave: str, cone: set[str]) -> set[str]:
        """Nodes of the cone from which the exit can be reached, without the two ends."""
        found, todo = {leave}, [leave]
        while todo:
            new = (self.into[todo.pop()] & cone) - found
            found |= new
            todo.extend(new)
        return found - {entry, leave}

    def site(self, i: int) -> tuple[int, list[str]] | None:
        """(index of the exit, interior nodes off the reference), or None."""
        entry = self.ref[i]
        if len(self.out[entry]) < 2:
            return None
        cone = self.reachable(i)
        if cone is None:
            return None
        for j in sorted(self.place[n] for n in cone if self.place.get(n, -1) > i):
            leave = self.ref[j]
            inner = self.between(entry, leave, cone)
            region = inner | {entry, leave}
            closed = self.out[entry] <= region and self.into[leave] <= region and all(self.adj[n] <= region for n in inner)
            if not closed:
                continue
            if region & self.loops:
                return None
            alleles = [n for n in inner if n not in self.place]
            if not alleles and not (leave in self.out[entry] and j > i + 1):
                continue
            return (j, alleles) if self._sound(entry, leave, region) else None
        return None

    def _sound(self, entry: str, leave: str, region: set[str]) -> bool:
        """One source, one sink, no cycle, every link seen in a walk, and fewer than `limit` bases on the longest way."""
        before = {n: self.into[n] & region for n in region}
        if {n for n in region if not before[n]} != {entry} or {n for n in region if not self.out[n] & region} != {leave}:
            return False
        try:
            order = list(TopologicalSorter(before).static_order())
        except CycleError:
            return False
        if any(m not in self.out[n] and n not in self.out[m] for n in region for m in self.adj[n] & region if m != n):
            return False
        longest = dict.fromkeys(region, 0)
        for n in order:
            if before[n]:
                longest[n] = max(longest[p] for p in before[n]) + (0 if n == leave else self.lengths.get(n, 0))
        return longest[leave] < self.limit

    def claim(self) -> list[tuple[int, int, list[str]]]:
        """Sites from left to right; reference nodes inside one open no other, nor do nodes visited twice."""
        twice = {n for i, n in enumerate(self.ref) if self.place[n] != i}
        taken: set[str] = set()
        sites = []
        for i, n in enumerate(self.ref):
            if n in twice or n in taken:
                continue
            found = self.site(i)
            if found:
                sites.append((i, found[0], found[1]))
                taken.update(self.ref[i + 1 : found[0]])
        return sites


def plan_collapse(segments: DataFrame, links: DataFrame, steps: DataFrame, ref: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(removed (locus_id, id, site), spans (locus_id, l, h, nodes, singles, bases)): reference indices of each site's
    ends. ref(locus_id, walk_pos); loci without a reference have no sites."""
    mine = steps.join(ref.select(*WALK), WALK, "left_semi")
    order = mine.select("locus_id", (F.row_number().over(Window.partitionBy("locus_id").orderBy("step_pos")) - 1).cast("long").alias("n"), F.col("id").alias("a"))
    index = order.groupBy("locus_id", F.col("a").alias("id")).agg(F.min("n").alias("idx"))
    # Walks read on the other strand, that follow the reference in the text, are taken backwards.
    start = ref.select("locus_id", F.col("walk_pos").alias("ref_pos"))
    turned = strand_votes(steps, index).filter("reversed").join(start, "locus_id").filter(F.col("walk_pos") > F.col("ref_pos")).select(*WALK, F.lit(True).alias("turned"))
    directed = steps.join(turned, WALK, "left").withColumn("step_pos", F.when(F.col("turned"), -F.col("step_pos")).otherwise(F.col("step_pos")))
    walk_out, _, walk_loops = walk_structure(directed.select(*WALK, "step_pos", "id"))
    adj, link_loops = link_structure(links, segments)
    none = F.lit(None)
    rows = order.select("locus_id", F.lit("ref").alias("kind"), "a", none.cast("string").alias("b"), "n")
    rows = rows.unionByName(segments.select("locus_id", F.lit("len").alias("kind"), F.col("id").alias("a"), none.cast("string").alias("b"), F.col("length").alias("n")))
    rows = rows.unionByName(walk_out.select("locus_id", F.lit("out").alias("kind"), "a", "b", none.cast("long").alias("n")))
    rows = rows.unionByName(adj.select("locus_id", F.lit("adj").alias("kind"), "a", "b", none.cast("long").alias("n")))
    rows = rows.unionByName(walk_loops.unionByName(link_loops).select("locus_id", F.lit("loop").alias("kind"), F.col("id").alias("a"), none.cast("string").alias("b"), none.cast("long").alias("n")))
    rows = rows.join(ref.select("locus_id"), "locus_id", "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by = dict(tuple(pdf.groupby("kind")))
        empty = pdf.iloc[:0]
        pairs = lambda k: list(zip(by.get(k, empty).a, by.get(k, empty).b, strict=True))
        lengths = by.get("len", empty)
        lengths = dict(zip(lengths.a, lengths.n.astype("int64"), strict=True))
        finder = SiteFinder(by.get("ref", empty).sort_values("n").a.tolist(), lengths, pairs("out"), pairs("adj"), set(by.get("loop", empty).a), limit)
        out = [(pdf.locus_id.iloc[0], l, h, sorted(inner), len(inner), sum(lengths.get(n, 0) == 1 for n in inner), sum(lengths.get(n, 0) for n in inner)) for l, h, inner in finder.claim()]
        return pd.DataFrame(out, columns=["locus_id", "l", "h", "ids", "nodes", "singles", "bases"])

    spans = rows.groupBy("locus_id").applyInPandas(run, "locus_id string, l long, h long, ids array<string>, nodes long, singles long, bases long")
    return spans


def removed_nodes(spans: DataFrame) -> DataFrame:
    return spans.select("locus_id", F.explode("ids").alias("id")).distinct()


def apply_collapse(segments: DataFrame, links: DataFrame, spans: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and links without removed nodes, and without links that jump inside a collapsed span."""
    gone = removed_nodes(spans)
    segments = segments.join(gone, ["locus_id", "id"], "left_anti")
    links = links.join(gone.withColumnRenamed("id", "from_id"), ["locus_id", "from_id"], "left_anti").join(gone.withColumnRenamed("id", "to_id"), ["locus_id", "to_id"], "left_anti")
    a, b = index.select("locus_id", F.col("id").alias("from_id"), F.col("idx").alias("a")), index.select("locus_id", F.col("id").alias("to_id"), F.col("idx").alias("b"))
    jumps = links.filter("from_id <> to_id").join(a, ["locus_id", "from_id"]).join(b, ["locus_id", "to_id"]).filter("abs(a - b) >= 2").select("locus_id", "link_pos", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    inside = spans_containing(jumps, spans, ["locus_id"]).filter("contained").select("locus_id", "link_pos")
    return segments, links.join(inside, ["locus_id", "link_pos"], "left_anti")


def reroute(steps: DataFrame, spans: DataFrame, ref_steps: DataFrame, index: DataFrame) -> DataFrame:
    """Walks led along the reference where they crossed a collapsed site.

    A run of removed steps between two reference steps becomes the reference steps between them (in reverse order
    and orientation when going back); a run that touches a walk's end or another node is dropped. Two reference steps
    in a row with a gap inside a collapsed span are filled the same way. ref_steps(locus_id, idx, id, rev) has every
    step of the reference, index(locus_id, id, idx) first visits."""
    kept = steps.join(removed_nodes(spans), ["locus_id", "id"], "left_anti").join(index.select("locus_id", "id", "idx"), ["locus_id", "id"], "left")
    kept = kept.withColumn("p_idx", F.lag("idx").over(along())).withColumn("p_pos", F.lag("step_pos").over(along()))
    lo, hi = F.least("idx", "p_idx"), F.greatest("idx", "p_idx")
    gaps = kept.filter((hi - lo) >= 2).select(*WALK, "step_pos", "p_pos", "idx", "p_idx", lo.alias("lo"), hi.alias("hi"))
    after_run = F.col("step_pos") > F.col("p_pos") + 1
    # Only distinct spans of reference are looked up, not every walk's.
    asked = gaps.filter(~after_run).select("locus_id", "lo", "hi").distinct()
    inside = spans_containing(asked, spans, ["locus_id"]).filter("contained").select("locus_id", "lo", "hi", F.lit(True).alias("inside"))
    gaps = gaps.join(inside, ["locus_id", "lo", "hi"], "left").filter(after_run | F.col("inside"))
    ahead = F.col("idx") > F.col("p_idx")
    fill = gaps.select(*WALK, "step_pos", ahead.alias("ahead"), F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("idx"))
    fill = fill.join(ref_steps.select("locus_id", "idx", "id", "rev"), ["locus_id", "idx"]).select(*WALK, "step_pos", F.when(F.col("ahead"), F.col("idx")).otherwise(-F.col("idx")).alias("sub"), "id", (F.col("rev") != ~F.col("ahead")).alias("rev"))
    own = kept.select(*WALK, "step_pos", F.lit(1 << 62).alias("sub"), "id", "rev")
    both = own.unionByName(fill)
    n = F.row_number().over(Window.partitionBy(*WALK).orderBy("step_pos", "sub")) - 1
    return both.select(*WALK, n.cast("long").alias("step_pos"), "id", "rev")
