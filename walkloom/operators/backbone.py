"""A reference for graphs that name none: stable coordinates, longest paths, or the component's long way through."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkloom.model import Graph
from walkloom.operators.assembly import valid_links
from walkloom.operators.iterate import components
from walkloom.sharedfs import materialize


def longest_contig(segments: DataFrame) -> DataFrame:
    """(locus_id, sn, bp): the stable name with most rank-0 bases, the first of equals."""
    ranked = segments.filter("sr = 0 and sn is not null and so is not null").groupBy("locus_id", "sn").agg(F.sum("length").alias("bp"), F.min("seg_pos").alias("pos"))
    best = Window.partitionBy("locus_id").orderBy(F.col("bp").desc(), "pos")
    return ranked.withColumn("n", F.row_number().over(best)).filter("n = 1").select("locus_id", "sn", "bp")


def stable_backbone(g: Graph) -> DataFrame:
    """(locus_id, place, id, contig, start, bp): rank-0 segments of the longest contig by offset, carried on at both
    ends through single untagged neighbours. Only tagged rows and untagged links of a locus are gathered."""
    best = longest_contig(g.segments).select("locus_id", "sn")
    core = g.segments.filter("sr = 0 and so is not null").join(best, ["locus_id", "sn"]).select("locus_id", F.lit("core").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("so").alias("x"), "length", F.col("seg_pos").alias("pos"), F.col("sn").alias("contig"))
    free = g.segments.filter("sr is null").select("locus_id", "id", "length")
    ends = core.select("locus_id", F.col("a").alias("id"), "length").unionByName(free)
    l = valid_links(g).join(ends.select("locus_id", F.col("id").alias("from_id"), F.col("length").alias("fl")), ["locus_id", "from_id"]).join(ends.select("locus_id", F.col("id").alias("to_id"), F.col("length").alias("tl")), ["locus_id", "to_id"])  # noqa: E741
    l = l.join(best, "locus_id", "left_semi").select("locus_id", F.lit("link").alias("kind"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("fl").alias("x"), F.col("tl").alias("length"), F.col("link_pos").alias("pos"), F.lit(None).cast("string").alias("contig"))  # noqa: E741

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        core = pdf[pdf.kind == "core"].sort_values(["x", "pos"])
        ids, size = core.a.tolist(), dict(zip(core.a, core.length, strict=True))
        tagged, start = set(ids), int(core.x.iloc[0])
        into, out = defaultdict(list), defaultdict(list)
        for r in pdf[pdf.kind == "link"].sort_values("pos").itertuples():
            into[r.b].append(r.a)
            out[r.a].append(r.b)
            size.setdefault(r.a, r.x)
            size.setdefault(r.b, r.length)
        used = set(ids)
        for step, at_front in ((into, True), (out, False)):
            while True:
                new = [n for n in step[ids[0] if at_front else ids[-1]] if n not in tagged and n not in used]
                if len(new) != 1:
                    break
                ids.insert(0 if at_front else len(ids), new[0])
                used.add(new[0])
                start -= int(size[new[0]]) if at_front else 0
        bp = int(sum(size[i] for i in ids))
        return pd.DataFrame({"locus_id": pdf.locus_id.iloc[0], "place": range(len(ids)), "id": ids, "contig": core.contig.iloc[0], "start": max(0, start), "bp": bp})

    return core.unionByName(l).groupBy("locus_id").applyInPandas(run, "locus_id string, place long, id string, contig string, start long, bp long")


def heaviest_path(segments: DataFrame, links: DataFrame, most_nodes: int = 50_000) -> DataFrame:
    """(locus_id, place, id, bp): the node-weighted longest path once links back to a node still being followed are
    dropped (nodes taken in input order, links too); self-loops are ignored; a locus without nodes, or with more than
    most_nodes, gives no rows."""
    small = segments.groupBy("locus_id").agg(F.count("*").alias("n")).filter(F.col("n") <= most_nodes)
    none = F.lit(None)
    rows = segments.select("locus_id", F.col("id").alias("a"), none.cast("string").alias("b"), "length", F.col("seg_pos").alias("pos")).unionByName(links.select("locus_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"), none.cast("long").alias("length"), F.col("link_pos").alias("pos"))).join(small, "locus_id", "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf.b.isna()].sort_values("pos")
        weight = dict(zip(nodes.a, nodes.length.astype("int64"), strict=True))
        onward = defaultdict(list)
        for r in pdf[pdf.b.notna()].sort_values("pos").itertuples():
            if r.a != r.b and r.a in weight and r.b in weight:
                onward[r.a].append(r.b)
        best: dict[str, tuple[int, str | None]] = {}  # heaviest way on from a node, and its next node
        open_: set[str] = set()
        for root in weight:
            todo = [] if root in best else [(root, iter(onward[root]))]
            open_.update(n for n, _ in todo)
            while todo:
                n, rest = todo[-1]
                new = next((m for m in rest if m not in best and m not in open_), None)
                if new is not None:
                    open_.add(new)
                    todo.append((new, iter(onward[new])))
                    continue
                todo.pop()
                open_.discard(n)
                ways = [(best[m][0], m) for m in onward[n] if m in best]
                top = max(ways, key=lambda w: w[0], default=(0, None))
                best[n] = (weight[n] + top[0], top[1])
        at = max(weight, key=lambda n: best[n][0])
        bp, path = best[at][0], []
        while at is not None:
            path.append(at)
            at = best[at][1]
        return pd.DataFrame({"locus_id": pdf.locus_id.iloc[0], "place": range(len(path)), "id": path, "bp": bp})

    return rows.groupBy("locus_id").applyInPandas(run, "locus_id string, place long, id string, bp long")


def component_backbones(links: DataFrame, paths: DataFrame, segments: DataFrame, reference_sample: str | None = None) -> DataFrame:
    """(locus_id, component, source, total_length, place, id, rev). Per component: the longest path (bases, at least
    1 a node), among the reference sample's where it has any, the first of equals; without paths the far ends of a
    double sweep, oriented by the links. paths(locus_id, walk_pos, step_pos, id, rev, path)."""
    edges = links.select("locus_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    comp = components(segments.select("locus_id", "id"), edges).join(segments.select("locus_id", "id", F.greatest(F.lit(1), "length").alias("w")), ["locus_id", "id"])
    comp = materialize(comp, "backbone-components")
    p = paths.join(comp, ["locus_id", "id"])
    is_ref = F.substring_index("path", "#", 1) == F.lit(reference_sample) if reference_sample else F.lit(False)
    cand = p.groupBy("locus_id", "component", "walk_pos", "path").agg(F.sum("w").alias("total")).withColumn("is_ref", is_ref)
    w = Window.partitionBy("locus_id", "component").orderBy(F.col("is_ref").desc(), F.col("total").desc(), "walk_pos")
    best = cand.withColumn("n", F.row_number().over(w)).filter("n = 1").select("locus_id", "component", "walk_pos", F.col("path").alias("source"), F.col("total").alias("total_length"))
    place = (F.row_number().over(Window.partitionBy("locus_id", "component").orderBy("step_pos")) - 1).cast("long")
    found = p.drop("path", "w").join(best, ["locus_id", "component", "walk_pos"]).select("locus_id", "component", "source", "total_length", place.alias("place"), "id", "rev")
    lone = comp.join(best, ["locus_id", "component"], "left_anti")
    node = lone.select("locus_id", "component", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), "w", F.lit(0).alias("ra"), F.lit(0).alias("rb"), F.lit(0).cast("long").alias("pos"))
    edge = links.join(lone.select("locus_id", F.col("id").alias("from_id"), "component"), ["locus_id", "from_id"]).select("locus_id", "component", F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(None).cast("long").alias("w"), F.col("from_rev").cast("int").alias("ra"), F.col("to_rev").cast("int").alias("rb"), F.col("link_pos").alias("pos"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = dict(zip(pdf.a[pdf.b.isna()], pdf.w[pdf.b.isna()].astype("int64"), strict=True))
        near, signs = defaultdict(list), defaultdict(list)
        for r in pdf[pdf.b.notna()].sort_values("pos").itertuples():
            signs[r.a, r.b].append((r.ra, r.rb))
            for x, y in ((r.a, r.b), (r.b, r.a)):
                if x != y and y in weight and y not in near[x]:
                    near[x].append(y)

        def sweep(start: str) -> tuple[dict, dict]:
            dist, up, queue = {start: weight[start]}, {start: None}, [(weight[start], start)]
            while queue:
                d, n = heapq.heappop(queue)
                for m in near[n] if d == dist[n] else ():
                    if d + weight[m] < dist.get(m, 1 << 62):
                        dist[m], up[m] = d + weight[m], n
                        heapq.heappush(queue, (dist[m], m))
            return dist, up

        far = lambda dist: max(dist, key=dist.__getitem__)
        dist, up = sweep(far(sweep(min(weight))[0]))
        path, at = [], far(dist)
        while at is not None:
            path.append(at)
            at = up[at]
        path.reverse()
        turn = [0]
        for x, y in zip(path, path[1:], strict=False):
            ahead, behind = signs.get((x, y)), signs.get((y, x))
            if ahead:
                turn.append(next((b for a, b in ahead if a == turn[-1]), ahead[0][1]))
            elif behind:
                turn.append(1 - next((a for a, b in behind if b == turn[-1]), behind[0][0]))
            else:
                turn.append(0)
        return pd.DataFrame({"locus_id": pdf.locus_id.iloc[0], "component": pdf.component.iloc[0], "source": "synthetic", "total_length": sum(weight[n] for n in path), "place": range(len(path)), "id": path, "rev": [bool(t) for t in turn]})

    swept = node.unionByName(edge).groupBy("locus_id", "component").applyInPandas(run, "locus_id string, component string, source string, total_length long, place long, id string, rev boolean")
    return found.select(*swept.columns).unionByName(swept)


def reference_cascade(g: Graph) -> DataFrame:
    """(locus_id, source): what a locus's axis comes from: W walk, P path, stable coordinates, longest path, none."""
    kinds = g.walks.groupBy("locus_id").agg(F.max(F.col("kind") == "W").alias("w"), F.max(F.col("kind") == "P").alias("p"))
    stable = longest_contig(g.segments).select("locus_id", F.lit(True).alias("s"))
    loci = g.segments.groupBy("locus_id").agg(F.count("*").alias("n"))
    x = loci.join(kinds, "locus_id", "left").join(stable, "locus_id", "left")
    return x.select("locus_id", F.when(F.col("w"), "W").when(F.col("p"), "P").when(F.col("s"), "rGFA").when(F.col("n") > 0, "longest").otherwise("none").alias("source"))


def synthetic_walk(g: Graph, path: DataFrame, sample: str = "backbone") -> Graph:
    """The graph with a computed backbone path(locus_id, place, id) in place of its walks."""
    steps = path.select("locus_id", F.lit(0).cast("long").alias("walk_pos"), F.col("place").alias("step_pos"), "id", F.lit(False).alias("rev"))
    span = path.join(g.segments.select("locus_id", "id", "length"), ["locus_id", "id"]).groupBy("locus_id").agg(F.sum("length").alias("end"))
    walks = span.select("locus_id", F.lit(0).cast("long").alias("walk_pos"), F.lit("synthetic").alias("kind"), F.lit(sample).alias("sample"), F.lit(0).alias("hap"), F.lit(sample).alias("seq_id"), F.lit(0).cast("long").alias("start"), "end", F.lit(1).cast("long").alias("weight"), F.create_map().cast("map<string,string>").alias("tags"))
    return g.with_(walks=walks, steps=steps)
