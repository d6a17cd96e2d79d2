"""Registered queries of the graph operators over the lenses, each with its DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom import lens
from walkloom.functions import sequence as sq
from walkloom.model import Graph
from walkloom.operators import assembly, axis, backbone, bubbles, coverage, events, genes, msa, range_join, unchop, walks
from walkloom.operators.iterate import components
from walkloom.plans import reduce as red
from walkloom.plans import report
from walkloom.sharedfs import materialize, shared_dir
from walkloom.sources import gfa, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

S, W, G, R = (f"({x})" for x in (lens.ORDER_STEPS, lens.ORDER_WALKS, lens.ORDER_SEGMENTS, lens.ORDER_REFERENCE))
TS, TG, TL, TP = (f"({x})" for x in (lens.TIME_STEPS, lens.TIME_SEGMENTS, lens.TIME_LINKS, lens.TEMPLATE))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _time_ref(g: Graph) -> DataFrame:
    return g.walks.filter("walk_pos = -1").select("locus_id", "walk_pos")


def _order_ref(spark: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    """The orders lens with its long reference as walk -1."""
    g = lens.order_graph(spark, d)
    g = g.with_(steps=g.steps.unionByName(lens.rows(spark, d, lens.ORDER_REFERENCE)))
    return g, g.segments.select("locus_id").distinct().withColumn("walk_pos", F.lit(-1).cast("long"))


PAIRS = f"(select locus_id, walk_pos, id as a, lead(id) over (partition by locus_id, walk_pos order by step_pos) as b from {S} s)"
AXIS = f"""(select locus_id, id, step_pos, rev, cast(sum(length) over (partition by locus_id order by step_pos) as bigint) as e, length
            from (select s.locus_id, s.id, s.step_pos, s.rev, coalesce(g.length, 0) as length from {{steps}} s left join {{segments}} g on g.locus_id = s.locus_id and g.id = s.id where s.walk_pos = -1) x)"""
T_AXIS = f"(select locus_id, id, e - length as st, e as en from {AXIS.format(steps=TS, segments=TG)} y)"


# --- totals, structure, coverage ----------------------------------------------------------------------------------


@query(f'select locus_id, cast(sum(weight) as bigint) as "TW", count(*) as "WR", count(distinct sample) as "NS" from {W} w group by 1')
def locus_totals(spark, d):
    return red.locus_totals(lens.order_graph(spark, d).walks)


@query(f"select distinct locus_id, a, b from {PAIRS} p where b is not null and a <> b")
def walk_edges_directed(spark, d):
    return walks.walk_structure(lens.order_graph(spark, d).steps)[0]


@query(f"select distinct locus_id, least(a, b) as a, greatest(a, b) as b from {PAIRS} p where b is not null and a <> b")
def walk_pairs_undirected(spark, d):
    return walks.walk_structure(lens.order_graph(spark, d).steps)[1]


@query(f"select distinct locus_id, a as id from {PAIRS} p where a = b")
def walk_self_loops(spark, d):
    return walks.walk_structure(lens.order_graph(spark, d).steps)[2]


@query(f"""
    with e as (select locus_id, walk_pos, min_by(id, step_pos) as f, max_by(id, step_pos) as l from {S} s group by 1, 2),
    n as (select locus_id, id, cast(sum(weight) as bigint) as wc from (select distinct locus_id, walk_pos, id from {S} s) x join {W} w using (locus_id, walk_pos) group by 1, 2),
    b as (select locus_id, f as id, sum(weight) as ws from e join {W} w using (locus_id, walk_pos) group by 1, 2),
    c as (select locus_id, l as id, sum(weight) as we from e join {W} w using (locus_id, walk_pos) group by 1, 2)
    select locus_id, id, wc, cast(coalesce(ws, 0) as bigint) as ws, cast(coalesce(we, 0) as bigint) as we from n left join b using (locus_id, id) left join c using (locus_id, id)""")
def node_coverage_distinct(spark, d):
    g = lens.order_graph(spark, d)
    return coverage.reduced_coverage(g.steps, g.walks)[0]


@query(f"""select locus_id, a, b, cast(sum(weight) as bigint) as wc from (select distinct locus_id, walk_pos, least(a, b) as a, greatest(a, b) as b from {PAIRS} p where b is not null and a <> b) x
           join {W} w using (locus_id, walk_pos) group by 1, 2, 3""")
def edge_coverage_distinct(spark, d):
    g = lens.order_graph(spark, d)
    return coverage.reduced_coverage(g.steps, g.walks)[1]


@query(f"select locus_id, cast(sum(weight) as bigint) as non_ref_walks from {W} w group by 1")
def non_ref_walk_totals(spark, d):
    g = lens.order_graph(spark, d)
    return coverage.reduced_coverage(g.steps, g.walks)[2]


@query(f"select locus_id, walk_pos, min_by(id, step_pos) as first_id, max_by(id, step_pos) as last_id from {S} s group by 1, 2")
def walk_starts_ends(spark, d):
    return walks.endpoints(lens.order_graph(spark, d).steps)


@query(f"select locus_id, id, count(*) as cov from {TS} s where walk_pos <> -1 group by 1, 2")
def node_coverage_bag(spark, d):
    g = lens.time_graph(spark, d)
    return coverage.event_coverage(g.steps, _time_ref(g))[0]


@query(f"""select locus_id, a, b, count(*) as cov from (select locus_id, walk_pos, id as a, lead(id) over (partition by locus_id, walk_pos order by step_pos) as b from {TS} s) p
           where walk_pos <> -1 and b is not null and a <> b group by 1, 2, 3""")
def edge_coverage_bag(spark, d):
    g = lens.time_graph(spark, d)
    return coverage.event_coverage(g.steps, _time_ref(g))[1]


@query(f"select locus_id, least(a, b) as a, greatest(a, b) as b, count(*) as cov from {PAIRS} p where b is not null group by 1, 2, 3")
def bubble_edge_coverage(spark, d):
    return coverage.bubble_coverage(lens.order_graph(spark, d))[1]


@query(f"select locus_id, id, count(distinct walk_pos) as cov from {S} s group by 1, 2")
def bubble_node_coverage(spark, d):
    return coverage.bubble_coverage(lens.order_graph(spark, d))[0]


@query(f"select g.locus_id, g.id, cast(count(distinct s.walk_pos) as bigint) as coverage from {G} g left join {S} s on s.locus_id = g.locus_id and s.id = g.id group by 1, 2")
def layout_coverage(spark, d):
    return coverage.layout_coverage(lens.order_graph(spark, d))


@query(f"""select locus_id, walk_pos, cast(count(*) filter (where i > p) as bigint) as up, cast(count(*) filter (where i < p) as bigint) as down, count(*) filter (where i < p) > count(*) filter (where i > p) as reversed
           from (select locus_id, walk_pos, i, lag(i) over (partition by locus_id, walk_pos order by step_pos) as p from (select locus_id, walk_pos, step_pos, cast(id as bigint) as i from {S} s) x) y group by 1, 2""")
def strand_vote(spark, d):
    g = lens.order_graph(spark, d)
    return walks.strand_votes(g.steps, g.segments.select("locus_id", "id", F.col("seg_pos").alias("idx")))


@query(f"""select locus_id, walk_pos, step_pos, rev, grp as id from (select *, lag(grp) over (partition by locus_id, walk_pos order by step_pos) as b from
           (select s.*, cast(s_nationkey as string) as grp from {S} s join supplier on cast(s_suppkey as string) = id where s_nationkey <> 7) x) y where grp is distinct from b""")
def run_collapse(spark, d):
    g = lens.order_graph(spark, d)
    to = lens.rows(spark, d, "select cast(s_suppkey as string) as id, cast(s_nationkey as string) as shown from supplier where s_nationkey <> 7")
    loci = g.segments.select("locus_id", "id").join(to, "id")
    return walks.collapse_runs(g.steps, loci).select("locus_id", "walk_pos", "step_pos", "rev", "id")


@query(f"""select locus_id, walk_pos, ids[1] as first_id, len(ids) as steps from (select locus_id, walk_pos, list(id order by step_pos) as ids from {S} s group by 1, 2) x""")
def walk_sequences(spark, d):
    return walks.walk_ids(lens.order_graph(spark, d).steps).select("locus_id", "walk_pos", F.get("ids", F.lit(0)).alias("first_id"), F.size("ids").cast("long").alias("steps"))


# --- reference axis -----------------------------------------------------------------------------------------------

_AXIS_OUT = f"select locus_id, id, cast(idx as bigint) as idx, start, e as \"end\", visits from (select locus_id, id, step_pos as idx, e - length as start, e, count(*) over (partition by locus_id, id) as visits, row_number() over (partition by locus_id, id order by step_pos {{}}) as n from {AXIS.format(steps=R, segments=G)} a) x where n = 1"


@query(_AXIS_OUT.format(""))
def reference_axis_first(spark, d):
    return axis.reference_axis(*_order_ref(spark, d), keep="first").drop("rev")


@query(_AXIS_OUT.format("desc"))
def reference_axis_last(spark, d):
    return axis.reference_axis(*_order_ref(spark, d), keep="last").drop("rev")


@query(f"select locus_id, cast(greatest(1, sum(length)) as bigint) as ref_len from {AXIS.format(steps=R, segments=G)} a group by 1")
def reference_length(spark, d):
    return axis.reference_length(*_order_ref(spark, d))


_SKIPS = f"""(select l.locus_id, from_id, to_id, least(a.en, b.en) as lo, greatest(a.st, b.st) as hi from {TL} l join {T_AXIS} a on a.locus_id = l.locus_id and a.id = from_id join {T_AXIS} b on b.locus_id = l.locus_id and b.id = to_id)"""


@query(f"select locus_id, from_id, to_id, cast(lo as bigint) as left_bp, cast(hi as bigint) as right_bp, cast(hi - lo as bigint) as gap from {_SKIPS} s where hi > lo")
def skip_edges(spark, d):
    g = lens.time_graph(spark, d)
    return axis.skip_edges(g.links, axis.reference_axis(g, _time_ref(g))).select("locus_id", "from_id", "to_id", F.col("left_bp").cast("long"), F.col("right_bp").cast("long"), F.col("gap").cast("long"))


@query(f"""select locus_id, id, cast(bp as bigint) as bp from (select l.locus_id, case when a.id is not null then to_id else from_id end as id, case when a.id is not null then a.en else b.st end as bp
           from {TL} l left join {T_AXIS} a on a.locus_id = l.locus_id and a.id = from_id left join {T_AXIS} b on b.locus_id = l.locus_id and b.id = to_id where (a.id is null) <> (b.id is null)) x""")
def ref_attach_points(spark, d):
    g = lens.time_graph(spark, d)
    return axis.attach_points(g.links, axis.reference_axis(g, _time_ref(g))).select("locus_id", "id", F.col("bp").cast("long").alias("bp"))


@query(f"select locus_id, cast(min(st) as bigint) as window_start, cast(max(en) as bigint) as window_end from {T_AXIS} a group by 1")
def locus_window(spark, d):
    g = lens.time_graph(spark, d)
    return axis.locus_window(axis.reference_axis(g, _time_ref(g))).select("locus_id", F.col("window_start").cast("long"), F.col("window_end").cast("long"))


# --- events -------------------------------------------------------------------------------------------------------

_EVENTS = f"""
    adj as (select locus_id, from_id as a, to_id as b from {TL} l union select locus_id, to_id, from_id from {TL} l),
    near as (select j.locus_id, j.a as id, count(*) as n, min_by(x.en, x.st) as l, max_by(x.st, x.st) as r from adj j join {T_AXIS} x on x.locus_id = j.locus_id and x.id = j.b group by 1, 2),
    cov as (select locus_id, id, count(*) as cov from {TS} s where walk_pos <> -1 group by 1, 2),
    node as (select g.locus_id, g.id, g.length as len, case when n = 1 then l else least(l, r) end as left_bp, case when n = 1 then l else greatest(l, r) end as right_bp, coalesce(cov, 0) as cov
             from {TG} g join near using (locus_id, id) left join cov using (locus_id, id) where g.id like '%:%'),
    pair as (select locus_id, least(a, b) as a, greatest(a, b) as b, count(*) as cov from (select locus_id, walk_pos, id as a, lead(id) over (partition by locus_id, walk_pos order by step_pos) as b from {TS} s) p where walk_pos <> -1 and b is not null and a <> b group by 1, 2, 3),
    gone as (select s.locus_id, 'del:' || from_id || '>' || to_id as id, 0 as len, lo as left_bp, hi as right_bp, coalesce(cov, 0) as cov from {_SKIPS} s left join pair p on p.locus_id = s.locus_id and p.a = least(from_id, to_id) and p.b = greatest(from_id, to_id) where hi > lo),
    every as (select * from node union all select * from gone),
    ev as (select locus_id, id, cast(len as bigint) as len, cast(left_bp as bigint) as left_bp, cast(right_bp as bigint) as right_bp, cast(greatest(0, right_bp - left_bp) as bigint) as skipped, cast(len - greatest(0, right_bp - left_bp) as bigint) as net, cast(cov as bigint) as cov from every)"""


@query(f"with {_EVENTS} select * from ev where greatest(len, skipped) > 8")
def nonref_events(spark, d):
    g = lens.time_graph(spark, d)
    return events.nonref_events(g, _time_ref(g), min_len=8).select("locus_id", "id", "len", F.col("left_bp").cast("long"), F.col("right_bp").cast("long"), "skipped", "net", "cov")


@query(f"""with {_EVENTS} select locus_id, case when net = 0 then 'sub' when net < 0 then 'del' when skipped = 0 then 'ins' else 'ins*' end as code, count(*) as n, cast(max(greatest(len, skipped)) as bigint) as largest from ev where greatest(len, skipped) > 0 group by 1, 2""")
def event_classes(spark, d):
    g = lens.time_graph(spark, d)
    e = events.classified(events.nonref_events(g, _time_ref(g)))
    return e.groupBy("locus_id", "code").agg(F.count("*").alias("n"), F.max(F.greatest("len", "skipped")).alias("largest"))


# --- components, bubbles, assembly --------------------------------------------------------------------------------

_OFF = f"(select locus_id, from_id as a, to_id as b from {TL} l where from_id like '%:%' and to_id like '%:%')"
_COMP = f"""with recursive e as (select locus_id, a, b from {_OFF} o union select locus_id, b, a from {_OFF} o),
    r as (select locus_id, id, id as root from {TG} g where id like '%:%' union select e.locus_id, e.b, r.root from r join e on e.locus_id = r.locus_id and e.a = r.id),
    c as (select locus_id, id, min(root) as component from r group by 1, 2)"""


def _alt(g: Graph) -> tuple[DataFrame, DataFrame]:
    alt = g.segments.filter("id like '%:%'").select("locus_id", "id")
    return alt, g.links.filter("from_id like '%:%' and to_id like '%:%'").select("locus_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"))


@query(f"{_COMP} select * from c")
def graph_components(spark, d):
    return components(*_alt(lens.time_graph(spark, d)))


@query(f"{_COMP} select locus_id, component, count(*) as size from c group by 1, 2")
def component_sizes(spark, d):
    return components(*_alt(lens.time_graph(spark, d))).groupBy("locus_id", "component").agg(F.count("*").alias("size"))


@query(f"""select locus_id, cast(70 as bigint) as entry_bp, cast(70 + ref_len as bigint) as exit_bp, ref_len as ref_span, alt_len as shortest, alt_len as longest, cast(1 as bigint) as node_count, cast(1 as bigint) as coverage, false as is_skip from {TP} t""")
def bubble_catalogue(spark, d):
    g = gfa.parse(lens.template_lines(spark, d)).stored()
    ref = g.walks.filter("sample = 'ref'").select("locus_id", "walk_pos")
    return bubbles.bubble_catalogue(g, ref).select("locus_id", "entry_bp", "exit_bp", "ref_span", "shortest", "longest", F.col("node_count").cast("long").alias("node_count"), "coverage", "is_skip")


@query(f"""select locus_id, cast(coalesce(max(case when 2 * run >= total then length end), 0) as bigint) as n50 from (select locus_id, length, sum(length) over (partition by locus_id order by length desc) as run, sum(length) over (partition by locus_id) as total from {TG} g) x group by 1""")
def n50(spark, d):
    return assembly.n50(lens.time_graph(spark, d).segments, ["locus_id"])


@query(f"select locus_id, cast(min(length) as double) as min, cast(quantile_disc(length, 0.5) as double) as median, cast(max(length) as double) as max, count(*) as covered from {TG} g where length > 12 group by 1")
def depth_summary(spark, d):
    s = lens.time_graph(spark, d).segments.withColumn("depth", F.when(F.col("length") > 12, F.col("length").cast("double"))).withColumn("depth_unit", F.lit("x"))
    return assembly.depth_summary(s).select("locus_id", "depth.min", "depth.median", "depth.max", "depth.covered")


_SIDES = f"(select locus_id, from_id as id, 'R' as side from {TL} l union select locus_id, to_id, 'L' from {TL} l)"


@query(f"select g.locus_id, g.id, cast(count(side) as int) as sides from {TG} g left join {_SIDES} s on s.locus_id = g.locus_id and s.id = g.id group by 1, 2")
def end_usage(spark, d):
    return assembly.end_usage(lens.time_graph(spark, d)).withColumn("sides", F.col("sides").cast("int"))


@query(f"""{_COMP.replace(_OFF, f"(select locus_id, from_id as a, to_id as b from {TL} l)").replace("where id like '%:%'", '')},
    u as (select g.locus_id, g.id, count(side) as sides from {TG} g left join {_SIDES} s on s.locus_id = g.locus_id and s.id = g.id group by 1, 2)
    select g.locus_id, count(*) as segments, cast(sum(length) as bigint) as total_bp, (select count(distinct component) from c where c.locus_id = g.locus_id) as components,
           (select count(*) from u where u.locus_id = g.locus_id and sides = 1) as dead_ends, (select count(*) from u where u.locus_id = g.locus_id and sides = 0) as isolated from {TG} g group by g.locus_id""")
def assembly_stats(spark, d):
    return assembly.assembly_stats(lens.time_graph(spark, d)).select("locus_id", "segments", "total_bp", "components", "dead_ends", "isolated")


# --- collapse, reroute, unchop, reduce ----------------------------------------------------------------------------

_CASE = f"(select *, greatest(ref_len, alt_len) < 50 as small from {TP} t)"


def _reduced(spark, d):
    return red.reduce_graph(gfa.parse(lens.template_lines(spark, d), strict=True), 50)


@query(f"""select locus_id, cast(6 as bigint) as "SB", cast(case when small then 1 else 4 end as bigint) as "SA", cast(6 as bigint) as "LB", cast(case when small then 0 else 4 end as bigint) as "LA",
    cast(case when small then 1 else 0 end as bigint) as "ST", cast(case when small then 1 else 0 end as bigint) as "NR", cast(case when small and alt_len = 1 then 1 else 0 end as bigint) as "SN", cast(case when small then alt_len else 0 end as bigint) as "BR",
    cast(case when small then 4 else 2 end as bigint) as "UM", w + 2 as "TW", w + 1 as "NW", cast(3 as bigint) as "NS", cast(3 as bigint) as "WR", cast(140 + ref_len + case when small then 0 else alt_len end as bigint) as "TS" from {_CASE} c""")
def collapse_stats(spark, d):
    return _reduced(spark, d).stats


@query(f"select locus_id, '20' as id from {_CASE} c where small")
def removed_nodes(spark, d):
    from walkloom.operators.collapse import removed_nodes as removed

    return removed(_reduced(spark, d).spans)


@query(f"""select locus_id, 'u1' as out_id, case when small then '1,2,3,4,5' else '1,2' end as members, cast(case when small then 140 + ref_len else 70 end as bigint) as length, w + 1 as wc, w + 1 as ws, case when small then w + 1 else 0 end as we from {_CASE} c
    union all select locus_id, '3', '3', ref_len, 1, 0, 0 from {_CASE} c where not small union all select locus_id, '20', '20', alt_len, w, 0, 0 from {_CASE} c where not small
    union all select locus_id, 'u4', '4,5', 70, w + 1, 0, w + 1 from {_CASE} c where not small""")
def reduced_coverage(spark, d):
    return _reduced(spark, d).chains.select("locus_id", "out_id", F.array_join("members", ",").alias("members"), "length", "wc", "ws", "we")


@query(f"""select locus_id, count(*) as records, cast(sum(n) as bigint) as n from (select locus_id, 2 as n from {_CASE} c union all select locus_id, 1 from {_CASE} c union all select locus_id, unnest(case when small then [1] else [1, 1, 1, 1, 1, 1, 1, 1] end) from {_CASE} c) x group by 1""")
def reduced_text(spark, d):
    lines = red.reduced_lines(_reduced(spark, d))
    return lines.groupBy("locus_id").agg((F.count_if(~F.col("value").startswith("W")) + 0).alias("records"), (F.count("*")).cast("long").alias("n"))


_LINE = "(select locus_id, id as x, next as y from (select locus_id, id, lead(id) over (partition by locus_id order by step_pos) as next from {s} s where walk_pos = -1) z where next is not null)"


@query(f"""with recursive ends as (select locus_id, id, count(*) filter (where side = 'R') as r, count(*) filter (where side = 'L') as l from (select locus_id, from_id as id, 'R' as side from {TL} l union all select locus_id, to_id, 'L' from {TL} l) x group by 1, 2),
    step as (select l.locus_id, from_id as x, to_id as y from {TL} l join ends a on a.locus_id = l.locus_id and a.id = from_id and a.r = 1 join ends b on b.locus_id = l.locus_id and b.id = to_id and b.l = 1),
    chain as (select g.locus_id, g.id, g.id as head, 0 as place from {TG} g where not exists (select 1 from step s where s.locus_id = g.locus_id and s.y = g.id) union select s.locus_id, s.y, c.head, c.place + 1 from chain c join step s on s.locus_id = c.locus_id and s.x = c.id)
    select locus_id, head, string_agg(id, ',' order by place) as members, count(*) as size from chain group by 1, 2""")
def unchop_chains(spark, d):
    from walkloom.operators.iterate import chain_positions

    g = lens.time_graph(spark, d)
    at = chain_positions(g.segments, unchop.merge_steps(g.links))
    return at.groupBy("locus_id", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",").alias("members"), F.count("*").alias("size"))


# --- range and as-of joins ----------------------------------------------------------------------------------------

_ITEMS = "(select l_orderkey as k, cast(l_partkey % 50 as bigint) as grp, cast(l_suppkey * 13 + l_linenumber as bigint) as a_start, cast(l_suppkey * 13 + l_linenumber + 1 + l_partkey % 9 as bigint) as a_end from lineitem)"
_WINDOWS = "(select s_suppkey as s, cast(s_suppkey % 50 as bigint) as grp, cast(s_suppkey * 11 as bigint) as b_start, cast(s_suppkey * 11 + 5 + s_suppkey % 20 as bigint) as b_end from supplier)"


@query(f"select i.grp, s, count(*) as n, cast(sum(k) as bigint) as keys from {_ITEMS} i join {_WINDOWS} w on i.grp = w.grp and a_start < b_end and b_start < a_end group by 1, 2")
def interval_overlap(spark, d):
    j = range_join.overlap_join(lens.rows(spark, d, _ITEMS[1:-1]), lens.rows(spark, d, _WINDOWS[1:-1]), ["grp"], "a_start", "a_end", "b_start", "b_end", 32)
    return j.groupBy("grp", "s").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


_ASK = "(select distinct cast(l_partkey % 50 as bigint) as grp, cast(l_suppkey * 11 + l_linenumber as bigint) as lo, cast(l_suppkey * 11 + l_linenumber + l_partkey % 12 as bigint) as hi from lineitem)"


@query(f"select grp, lo, hi, exists (select 1 from {_WINDOWS} w where w.grp = a.grp and b_start <= lo and hi <= b_end) as contained from {_ASK} a")
def span_contains(spark, d):
    spans = lens.rows(spark, d, _WINDOWS[1:-1])
    return range_join.spans_containing(lens.rows(spark, d, _ASK[1:-1]), spans, ["grp"], l="b_start", h="b_end")


_BLOCKS = "(select cast(p_size % 5 as bigint) as grp, p_partkey as part, cast(1 + p_partkey % 9 as bigint) as bp_len, cast(sum(10 + p_size % 3) over (partition by p_size % 5 order by p_partkey) - 10 - p_size % 3 as bigint) as col_start from part)"
_POINTS = "(select distinct cast(l_linenumber % 5 as bigint) as grp, cast(l_suppkey * 3 + l_linenumber as bigint) as bp from lineitem)"


@query(f"select p.grp, bp, (select max(part) from {_BLOCKS} b where b.grp = p.grp and col_start <= bp and bp < col_start + bp_len) as part from {_POINTS} p")
def point_in_block(spark, d):
    p = range_join.point_in_block(lens.rows(spark, d, _POINTS[1:-1]), lens.rows(spark, d, _BLOCKS[1:-1]), ["grp"])
    return p.select("grp", "bp", F.col("block.part").alias("part"))


# --- haplotypes ---------------------------------------------------------------------------------------------------


@query(f"select distinct locus_id, walk_pos from {S} s where id in ('3', '7')")
def walks_through_node(spark, d):
    g = lens.order_graph(spark, d)
    return walks.walks_through(g.steps, g.segments.filter("id in ('3', '7')"))


@query(f"""select distinct p.locus_id, p.walk_pos from (select locus_id, walk_pos, id as a, lead(id) over (partition by locus_id, walk_pos order by step_pos) as b from {TS} s) p join (select * from {_SKIPS} s where hi > lo) s
           on s.locus_id = p.locus_id and ((s.from_id = p.a and s.to_id = p.b) or (s.from_id = p.b and s.to_id = p.a))""")
def walks_taking_skip(spark, d):
    g = lens.time_graph(spark, d)
    e = axis.skip_edges(g.links, axis.reference_axis(g, _time_ref(g))).select("locus_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return walks.walks_taking(g.steps, e)


@query(f"""select locus_id, least(f, r) as trace, count(*) as walks, min(walk_pos) as first_pos from (select locus_id, walk_pos, string_agg(id, '>' order by step_pos) as f, string_agg(id, '>' order by step_pos desc) as r from {S} s group by 1, 2) x group by 1, 2""")
def distinct_traces(spark, d):
    return walks.distinct_traces(lens.order_graph(spark, d).steps)


@query(f"""select locus_id, walk_pos, name from (select locus_id, walk_pos, sample || '#' || cast(hap as string) || '#' || seq_id as name, row_number() over (partition by locus_id, sample, hap, seq_id order by walk_pos) as n from {W} w) x where n = 1""")
def named_walks(spark, d):
    return walks.named_walks(lens.order_graph(spark, d).walks).select("locus_id", "walk_pos", "name")


@query(f"select locus_id, walk_pos from {W} w where lower(sample || ' ' || seq_id || ' hap ' || cast(hap as string)) like '%s1 chr%'")
def walk_search(spark, d):
    g = lens.order_graph(spark, d)
    return walks.search_walks(g.walks, "S1 CHR").select("locus_id", "walk_pos")


@query(f"select locus_id, sample, min(walk_pos) as first_pos from {W} w group by 1, 2")
def samples_in_order(spark, d):
    return walks.samples_in_order(lens.order_graph(spark, d).walks)


@query(f"""select locus_id, '#ref' as key, true as is_reference, cast(1 as bigint) as multiplicity, false as through_selected, cast(5 as bigint) as filled from {TP} t
    union all select locus_id, 'alt#0#chr1', false, 1, true, 5 from {TP} t union all select locus_id, 'r1#0#chr1', false, 1, false, 5 from {TP} t""")
def alignment_rows(spark, d):
    g = gfa.parse(lens.template_lines(spark, d))
    picked = g.segments.filter("id = '20'").select("locus_id", "id")
    a = msa.build_alignment(g, picked, "ref", window_bp=300)
    return a.rows.select("locus_id", "key", "is_reference", F.col("multiplicity").cast("long").alias("multiplicity"), "through_selected", F.size(F.filter("cells", lambda c: c.isNotNull())).cast("long").alias("filled"))


@query(f"""select locus_id, name, seg_id, cast(col as bigint) as col_start, len as bp_len from (
    select locus_id, unnest(['R1', 'R2', 'A1', 'R3', 'R4', 'R5']) as name, unnest(['1', '2', '20', '3', '4', '5']) as seg_id, unnest([0, 50, 70, 70 + alt_len, 70 + alt_len + ref_len, 90 + alt_len + ref_len]) as col, unnest([50, 20, alt_len, ref_len, 20, 50]) as len from {TP} t) x""")
def alignment_blocks(spark, d):
    g = gfa.parse(lens.template_lines(spark, d))
    a = msa.build_alignment(g, g.segments.filter("id = '20'").select("locus_id", "id"), "ref", window_bp=300)
    return a.blocks.select("locus_id", "name", "seg_id", F.col("col_start").cast("long"), "bp_len")


# --- genes --------------------------------------------------------------------------------------------------------

_GENES = "(select 'GRCh38' as ref, p_brand || '-' || p_type as symbol, 'chr' || cast(p_size % 22 + 1 as string) as contig, cast(p_partkey * 100 as bigint) as start, cast(p_partkey * 100 + p_size * 900 as bigint) as \"end\", cast(p_partkey as bigint) as pos from part)"


def _genes(spark, d) -> DataFrame:
    return lens.rows(spark, d, _GENES[1:-1])


@query(f"""select symbol, contig, start, "end" from (select *, row_number() over (partition by symbol order by "end" - start desc, pos) as n from {_GENES} g) x where n = 1""")
def longest_span(spark, d):
    return genes.longest_spans(_genes(spark, d))


@query(f"""select symbol, locus from (select symbol, contig || ':' || cast(cast(greatest(0, start - pad) as bigint) as string) || '-' || cast(cast("end" + pad as bigint) as string) as locus
    from (select *, case when "end" - start < 20000 then floor((20000 - ("end" - start)) / 2.0 + 0.5) else 0 end as pad from {_GENES} g) x) y""")
def gene_loci(spark, d):
    return genes.gene_loci(_genes(spark, d)).select("symbol", "locus")


@query(f"""select key, symbol, rank from (select upper(symbol) as key, max_by(symbol, pos) as symbol, case when upper(symbol) = 'BRAND#1' then 0 when upper(symbol) like 'BRAND#1%' then 1 else 2 end as rank from {_GENES} g where upper(symbol) like '%BRAND#1%' group by 1, 3) x order by rank, symbol limit 8""")
def gene_search(spark, d):
    return genes.search_genes(_genes(spark, d), " brand#1 ").select("key", "symbol", "rank")


_TRANSCRIPTS = "(select cast(o_custkey as string) as symbol, o_orderpriority = '1-URGENT' as canonical, cast(o_orderkey as bigint) as pos, cast(o_orderkey % 97 as bigint) as cds_start, cast(o_orderkey % 97 + o_custkey % 31 + o_orderkey % 13 as bigint) as cds_end, cast(o_orderkey % 89 as bigint) as start, cast(o_orderkey % 89 + o_orderkey % 17 as bigint) as \"end\" from orders)"


@query(f"""select symbol, pos from (select *, row_number() over (partition by symbol order by canonical desc, cds_end - cds_start desc, "end" - start desc, pos) as n from {_TRANSCRIPTS} t) x where n = 1""")
def representative(spark, d):
    return genes.representative_transcripts(lens.rows(spark, d, _TRANSCRIPTS[1:-1]), ["symbol"], "pos").select("symbol", "pos")


_TEXTS = "(select 'chr' || cast(p_size as string) || ':' || cast(p_partkey as string) || ',000-' || cast(p_partkey + p_size - 3 as string) || ',000' as text from part)"


@query(f"""select text, regexp_extract(text, '^([^:]+)', 1) as contig, cast(replace(regexp_extract(text, ':([0-9,]+)-', 1), ',', '') as bigint) as start, cast(replace(regexp_extract(text, '-([0-9,]+)$', 1), ',', '') as bigint) as "end" from {_TEXTS} t
    where cast(replace(regexp_extract(text, '-([0-9,]+)$', 1), ',', '') as bigint) > cast(replace(regexp_extract(text, ':([0-9,]+)-', 1), ',', '') as bigint)""")
def parse_loci(spark, d):
    return genes.parse_loci(lens.rows(spark, d, _TEXTS[1:-1])).filter("error is null").select("text", "contig", "start", "end")


# --- functions, text, reports -------------------------------------------------------------------------------------


@query("select doc_id, reverse(translate(text, 'ACGTacgtUu', 'TGCAtgcaAA')) as text from documents")
def revcomp_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", sq.revcomp(F.col("text")).alias("text"))


@query(f"select locus_id, cast(6 as bigint) as segments, cast(6 as bigint) as links, cast(3 as bigint) as walks, cast(140 + ref_len + alt_len as bigint) as total_sequence_bp, cast(3 as bigint) as samples, cast(140 + ref_len as bigint) as reference_path_bp from {TP} t")
def gfa_parse(spark, d):
    return report.gfa_stats(gfa.parse(lens.template_lines(spark, d)), "ref").drop("walk_records")


@query(SQL["gfa_parse"])
def gfa_file_parse(spark, d):
    """The same loci written as text files and read again."""
    path = f"{shared_dir(spark)}/gfa-{uuid.uuid4().hex}"
    gfa.write_lines(lens.template_lines(spark, d), path)
    return report.gfa_stats(gfa.parse(gfa.read_lines(spark, path)), "ref").drop("walk_records")


_NEAR = 60  # bases of context


@query(f"""with recursive e as (select locus_id, from_id as a, to_id as b from {TL} l union select locus_id, to_id, from_id from {TL} l),
    r as (select locus_id, id, cast(0 as bigint) as dist from {T_AXIS} x where locus_id = 'T1' and st < 150 and en > 100
          union select e.locus_id, e.b, r.dist + case when r.dist = 0 then 0 else g.length end + 1 from r join e on e.locus_id = r.locus_id and e.a = r.id join {TG} g on g.locus_id = r.locus_id and g.id = r.id
          where r.dist + case when r.dist = 0 then 0 else g.length end + 1 <= {_NEAR}),
    n as (select distinct locus_id, id from r)
    select n.id, g.length, (select count(*) from {TL} l join n a on a.id = l.from_id join n b on b.id = l.to_id where l.locus_id = 'T1') as links,
           (select count(*) from {TS} s join n using (locus_id, id)) as steps
    from n join {TG} g on g.locus_id = n.locus_id and g.id = n.id""")
def locus_query(spark, d):
    """A stored graph asked for one locus with context: its segments, each with the numbers of links and steps."""
    g = lens.time_graph(spark, d)
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    stored.store_graph(g, _time_ref(g).select("locus_id", "walk_pos", F.lit("ref").alias("sample"), F.col("locus_id").alias("contig")), path, bin_bp=64)
    cut = stored.read_locus(spark, path, "ref", "T1", 100, 150, context=_NEAR)
    links, steps = cut.links.agg(F.count("*").alias("links")), cut.steps.agg(F.count("*").alias("steps"))
    one = links.withColumn("one", F.lit(1)).join(steps.withColumn("one", F.lit(1)), "one")
    return cut.segments.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").select("id", "length", "links", "steps")


@query(f"""select locus_id, cast(case when small then 1 else 4 end as bigint) as nodes, cast(6 as bigint) as nodes_before, w + 2 as walks, cast(140 + ref_len + case when small then 0 else alt_len end as bigint) as total_sequence_bp, cast(140 + ref_len as bigint) as reference_path_bp, true as simplified from {_CASE} c""")
def complexity_report(spark, d):
    text = red.reduced_lines(_reduced(spark, d))
    return report.graph_complexity(gfa.parse(materialize(text, "reduced-text")), "ref").select("locus_id", "nodes", "nodes_before", "walks", "total_sequence_bp", "reference_path_bp", "simplified")


@query("select cast(s_suppkey as string) as id, s_suppkey % 60 as v, case when s_suppkey * 137 > 250000 or s_suppkey * 31 > 25000 then 'risky' when s_suppkey * 31 <= 6000 and s_suppkey * 137 <= 20000 then 'auto' else 'manual' end as tier from supplier")
def walk_load_tiers(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_suppkey") % 60).alias("v"), report.walk_load_tier(F.col("s_suppkey") * 31, F.col("s_suppkey") * 137).alias("tier"))


@query()
def reference_source(spark, d):
    return backbone.reference_cascade(gfa.parse(lens.template_lines(spark, d)))


@query()
def heaviest_paths(spark, d):
    g = lens.time_graph(spark, d)
    return backbone.heaviest_path(g.segments, g.links)


@query()
def component_backbones(spark, d):
    g = lens.time_graph(spark, d)
    links, paths, _ = walks.layout_paths(g, "ref")
    return backbone.component_backbones(links, paths, g.segments, "ref")


@query()
def graph_layout(spark, d):
    from walkloom.operators.layout import layout

    g = lens.time_graph(spark, d)
    return layout(g.segments, g.links, axis.reference_axis(g, _time_ref(g)), "layered")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_stats(spark, sf_dir)
