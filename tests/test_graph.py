import random

import pytest
from fixtures import FIXTURES, GOLDEN_TAGS, GOLDENS, bases, gfa, texts
from pyspark.sql import functions as F

from walkloom.model import pick_reference
from walkloom.operators import assembly, axis, backbone, bubbles, events, msa, walks
from walkloom.plans.reduce import reduce_graph, reduced_lines
from walkloom.plans.report import gfa_stats, graph_complexity, next_context, query_arguments
from walkloom.sharedfs import materialize
from walkloom.sources.gfa import flip_orientation, lines_of, parse, read_lines, size_guard, write_lines


def weighted(w):
    head = "H\tRS:Z:ref\n" + "".join(f"S\t{i}\t{bases(n)}\n" for i, n in ((1, 10), (2, 1), (3, 1), (4, 10))) + "".join(f"L\t{a}\t+\t{b}\t+\t0M\n" for a, b in ((1, 2), (2, 4), (1, 3), (3, 4)))
    return head + "W\tref\t0\tc\t0\t21\t>1>2>4\n" + w


STRAND = "H\tRS:Z:ref\n" + "".join(f"S\t{i}\t{bases(n)}\n" for i, n in ((1, 10), (2, 1), (3, 1), (4, 10), (5, 1), (6, 1), (7, 10))) + "".join(f"L\t{a}\t+\t{b}\t+\t0M\n" for a, b in ((1, 2), (2, 4), (1, 3), (3, 4), (4, 5), (5, 7), (4, 6), (6, 7))) + "W\tref\t0\tc\t0\t32\t>1>2>4>5>7\nW\talt\t0\tc\t0\t32\t>1>3>4>6>7\n"


@pytest.fixture(scope="module")
def reduced(spark):
    more = {
        "w_three": weighted("".join(f"W\ta{k}\t0\tc\t0\t21\t>1>3>4\n" for k in range(3))), "w_one": weighted("W\ta0\t0\tc\t0\t21\t>1>3>4\tWT:i:3\n"),
        "s_base": STRAND, "s_back": STRAND + "W\tinv\t0\tc\t0\t32\t<7<5<4<2<1\n",
    }
    flipped = flip_orientation(lines_of(spark, {f"f_{k}": v for k, v in texts().items()}))
    lines = lines_of(spark, texts() | more).unionByName(flipped)
    g = parse(lines, strict=True).stored()
    r = reduce_graph(g, 50)
    return g, r, {x.locus_id: x.asDict() for x in r.stats.collect()}


def test_goldens(reduced):
    _, _, stats = reduced
    for name, want in GOLDENS.items():
        assert tuple(stats[name][t] for t in GOLDEN_TAGS) == want, name


def test_flip_changes_nothing(reduced):
    _, _, stats = reduced
    for name in FIXTURES:
        assert [stats[name][t] for t in ("SB", "SA", "UM", "ST", "NR")] == [stats[f"f_{name}"][t] for t in ("SB", "SA", "UM", "ST", "NR")], name


def test_weights_and_strand(reduced):
    _, r, s = reduced
    assert [s["w_three"][t] for t in ("TW", "NW")] == [s["w_one"][t] for t in ("TW", "NW")] == [4, 3] and (s["w_three"]["WR"], s["w_one"]["WR"]) == (4, 2)
    cov = {(x.locus_id, x.out_id): x.wc for x in r.chains.filter("locus_id like 'w_%'").collect()}
    assert cov["w_three", "u1"] == cov["w_one", "u1"] == 3
    assert s["s_base"]["ST"] == 2 and all(s["s_base"][t] == s["s_back"][t] for t in ("ST", "NR", "SA"))


def test_reference_sequence_and_text(reduced, spark):
    g, r, stats = reduced
    lines = materialize(reduced_lines(r), "lines")
    again = parse(lines).stored()
    seq = again.steps.join(again.segments, ["locus_id", "id"]).groupBy("locus_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_pos", "seq"))), lambda x: x["seq"]), "").alias("s"))
    got = {x.locus_id: x.s for x in seq.filter("locus_id not like 'f_%'").collect()}
    for name, (nodes, _, paths) in FIXTURES.items():
        size = dict(x.split(":") for x in nodes.split())
        ref = next(p for k, p in paths.items() if k.startswith("ref"))
        assert got[name] == "".join(bases(int(size[i])) for i in ref.split()), name
    cx = {x.locus_id: x for x in graph_complexity(again, "ref").collect()}
    assert all(cx[n].simplified and cx[n].nodes == stats[n]["SA"] and cx[n].nodes_before == stats[n]["SB"] for n in GOLDENS)
    mixed = {x.value for x in lines.filter("locus_id = 'mixed'").collect()}
    assert {"L\tu1\t+\t5\t+\t0M\tWC:i:3", "L\tu1\t+\t30\t+\t0M\tWC:i:2", "L\t30\t+\t5\t+\t0M\tWC:i:2", "W\tref\t0\tchr1\t0\t141\t>u1>5"} <= mixed
    assert not size_guard(lines).filter("refused").count() and size_guard(lines, 10).filter("not refused").count() == 0


def one(spark, text, **how):
    return parse(lines_of(spark, {"x": text}), **how).stored()


def test_viewer_parse(spark):
    g = one(spark, "S\ts1\t*\tLN:i:5000\nS\ts2\tACGT\tdp:f:20\tMB:Z:a,b\nS\ts2\tACG\tRC:i:7\nL\ts1\t+\ts2\t-\t0M\tWC:i:3\nP\tx\ts1+,s2-,q,*\t*\nW\tm\t1\tc\t5\t9\t>s1<s2\tAA:Z:u:v\tWT:i:4\nZ\tjunk\n")
    s = {r.id: r for r in g.segments.collect()}
    assert (s["s1"].length, s["s1"].seq, s["s2"].length, s["s2"].depth, s["s2"].depth_unit, s["s2"].wc) == (5000, "", 3, 7.0, "reads", None)
    w = {r.kind: r for r in g.walks.collect()}
    assert (w["P"].sample, w["P"].seq_id, w["P"].end) == ("x", "x", 5003) and w["W"].tags["AA"] == "u:v" and w["W"].weight == 4
    assert [(r.id, r.rev) for r in g.steps.join(g.walks.filter("kind = 'P'"), ["locus_id", "walk_pos"]).orderBy("step_pos").collect()] == [("s1", False), ("s2", True)]
    st = gfa_stats(g, "m").first()
    assert (st.segments, st.total_sequence_bp, st.reference_path_bp, st.walk_records) == (2, 5003, 4, None)
    strict = one(spark, "S\ts1\tA\nS\t2\t*\nS\t2\tACGT\nP\tx\t2+\t*\n", strict=True)
    assert [(r.id, r.length) for r in strict.segments.collect()] == [("2", 1)] and strict.walks.count() == 0


def test_assembly(spark):
    text = "".join(f"S\t{i}\t*\tLN:i:{n}\n" for i, n in ((1, 300), (2, 100), (3, 300), (9, 50))) + "L\t1\t+\t2\t+\t0M\nL\t2\t+\t3\t+\t0M\nL\t2\t+\t2\t+\t0M\nL\t2\t+\tnone\t+\t0M\n"
    r = assembly.assembly_stats(one(spark, text)).first()
    assert (r.components, r.self_loops, r.isolated, r.dead_ends, r.largest_fraction, r.total_bp, r.n50, r.depth) == (2, 1, 1, 2, 0.75, 750, 300, None)
    rep = assembly.segment_report(one(spark, text), "2").first()
    assert rep.neighbours == ["1", "3", "none"] and rep.length == 100


def test_bubbles(spark):
    text = "".join(f"S\t{i}\t*\tLN:i:{n}" + (f"\tWC:i:{c}" if c else "") + "\n" for i, n, c in ((1, 100, 9), (2, 100, 9), (3, 100, 9), (10, 50, 8), (11, 30, 3), (12, 20, 5)))
    text += "".join(f"L\t{a}\t+\t{b}\t+\t0M{t}\n" for a, b, t in ((1, 2, ""), (2, 3, ""), (1, 10, ""), (1, 11, ""), (10, 12, ""), (11, 12, ""), (12, 2, ""), (1, 3, "\tWC:i:4")))
    g = one(spark, text + "W\tref\t0\tc\t1000\t1300\t>1>2>3\n")
    rows = bubbles.in_order(bubbles.bubble_catalogue(g, pick_reference(g, "ref"))).collect()
    b, s = (next(r for r in rows if r.is_skip == k) for k in (False, True))
    assert (b.entry_bp, b.exit_bp, b.longest, b.shortest, b.node_count, b.coverage, b.node_ids) == (100, 100, 70, 50, 3, 8, ["10", "11", "12"])
    assert (s.entry_bp, s.exit_bp, s.ref_span, s.longest, s.coverage) == (100, 200, 100, 0, 4)
    plain = one(spark, "S\t1\t*\tLN:i:9\nS\t2\t*\tLN:i:9\nS\t3\t*\tLN:i:9\nS\t10\t*\tLN:i:40\n" + "".join(f"L\t{a}\t+\t{b}\t+\t0M\n" for a, b in ((1, 2), (2, 3), (1, 3), (1, 10), (10, 3))) + "W\tref\t0\tc\t0\t27\t>1>2>3\nW\tA\t0\tc\t0\t1\t>1>3\nW\tB\t0\tc\t0\t1\t>1>3\nW\tC\t0\tc\t0\t1\t>1>10>3\n")
    got = {r.is_skip: r.coverage for r in bubbles.bubble_catalogue(plain, pick_reference(plain, "ref")).collect()}
    assert got == {True: 2, False: 1}


def test_reduced_events(spark):
    text = "X\tNW:i:19\tSB:i:9\nS\t1\t*\tLN:i:5\nS\t2\t*\tLN:i:3\tWC:i:12\nS\t3\t*\tLN:i:5\nS\t4\t*\tLN:i:7\tWC:i:7\tWE:i:2\n" + "L\t1\t+\t2\t+\t0M\nL\t2\t+\t3\t+\t0M\nL\t1\t+\t4\t+\t0M\nL\t4\t+\t3\t+\t0M\nL\t1\t+\t3\t+\t0M\tWC:i:5\nW\tref\t0\tc\t1000\t1013\t>1>2>3\n"
    g = one(spark, text)
    e = {r.id: r for r in events.classified(events.nonref_events(g, pick_reference(g, "ref"))).collect()}
    assert (e["4"].cov, e["4"].left_bp, e["4"].right_bp, e["4"].net, e["4"].code) == (7, 5, 8, 4, "ins*") and (e["del:1>3"].cov, e["del:1>3"].skipped) == (5, 3)
    s = {r.id: (r.wc, r.ws, r.we) for r in g.segments.collect()}
    assert s["4"] == (7, None, 2) and s["1"] == (None, None, None)


def msa_graph(alt, extra=""):
    nodes = "".join(f"S\t{i}\t{s}\n" for i, s in ((1, "AAAA"), (2, "CCCC"), (3, "G"), (4, "TTTT"), (5, "AAAA"), (20, alt)))
    return nodes + "".join(f"L\t{a}\t+\t{b}\t+\t0M\n" for a, b in ((1, 2), (2, 3), (3, 4), (4, 5), (2, 20), (20, 4))) + "W\tref\t0\tc\t0\t17\t>1>2>3>4>5\nW\ta\t0\tc\t0\t17\t>1>2>20>4>5\nW\tb\t0\tc\t0\t17\t>1>2>20>4>5\n" + extra


def test_alignment(spark):
    g = one(spark, msa_graph("C", "W\tinv\t0\tc\t0\t9\t>1<2>3\nW\tsyn\t0\tc\t0\t17\n"))
    pick = spark.createDataFrame([("x", "20")], "locus_id string, id string")
    a = msa.build_alignment(g, pick, "ref", window_bp=100)
    assert [(r.name, r.seg_id) for r in a.blocks.orderBy("block").collect()] == [("R1", "1"), ("R2", "2"), ("A1", "20"), ("R3", "3"), ("R4", "4"), ("R5", "5")]
    rows = a.rows.orderBy("row").collect()
    assert rows[0].is_reference and rows[0].cells[2] is None and rows[0].cells[3] == "G"
    assert (rows[1].multiplicity, rows[1].through_selected, rows[1].cells[2], rows[1].cells[3]) == (2, True, "C", None)
    assert rows[2].has_inversion and rows[2].cells[1] == "GGGG" and not rows[2].through_selected


def test_backbones(spark):
    rgfa = "S\troot\t*\tLN:i:10\nS\tr1\t*\tLN:i:100\tSN:Z:chrX\tSO:i:10\tSR:i:0\nS\tr2\t*\tLN:i:200\tSN:Z:chrX\tSO:i:110\tSR:i:0\nS\ta1\t*\tLN:i:5\tSN:Z:q\tSO:i:0\tSR:i:1\nL\troot\t+\tr1\t+\t0M\nL\tr1\t+\tr2\t+\t0M\n"
    got = backbone.stable_backbone(one(spark, rgfa)).orderBy("place").collect()
    assert [r.id for r in got] == ["root", "r1", "r2"] and (got[0].start, got[0].bp, got[0].contig) == (0, 310, "chrX")

    def longest(sizes, pairs, most=50_000):
        text = "".join(f"S\t{k}\t*\tLN:i:{v}\n" for k, v in sizes.items()) + "".join(f"L\t{a}\t+\t{b}\t+\t0M\n" for a, b in pairs)
        g = one(spark, text)
        rows = backbone.heaviest_path(g.segments, g.links, most).orderBy("place").collect()
        return [r.id for r in rows], rows[0].bp if rows else None

    assert longest({"a": 10, "b": 20, "c": 5}, [("a", "b"), ("b", "c")]) == (["a", "b", "c"], 35)
    assert longest({"a": 100, "b": 50, "c": 5, "d": 100}, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]) == (["a", "b", "d"], 250)
    ids, bp = longest({"a": 10, "b": 10, "c": 10}, [("a", "b"), ("b", "c"), ("c", "a")])
    assert len(set(ids)) == 3 and bp == 30
    assert longest({"a": 10, "b": 20}, [("a", "a"), ("a", "b"), ("b", "b")]) == (["a", "b"], 30)
    assert longest({"a": 1, "b": 1, "c": 1}, [("a", "b")], 2) == ([], None)
    chain = longest({f"n{i}": 1 for i in range(20_000)}, [(f"n{i}", f"n{i + 1}") for i in range(19_999)])
    assert len(chain[0]) == chain[1] == 20_000


def test_random_graphs_keep_invariants(spark):
    rng, many = random.Random(8), {}
    for k in range(6):
        nodes, links, alt, path = ["1:30"], [], [1], [1]
        for i in range(2, 12):
            nodes.append(f"{i}:{rng.randrange(1, 60)}")
            links.append(f"{i - 1}-{i}")
            path.append(i)
            if i > 2 and rng.random() < 0.4:
                nodes.append(f"{100 + i}:{rng.randrange(1, 90)}")
                links += [f"{i - 2}-{100 + i}", f"{100 + i}-{i}"]
                alt[-1:] = [100 + i, i] if alt[-1] == i - 1 else [alt[-1]]
                alt += [] if alt[-1] == i else [i]
            else:
                alt.append(i)
        many[f"g{k}"] = gfa(" ".join(nodes), " ".join(links), {"ref": " ".join(map(str, path)), "a b": " ".join(map(str, alt))})
    g = parse(lines_of(spark, many), strict=True).stored()
    before = None
    for limit in (10, 50, 250):
        r = reduce_graph(g, limit)
        s = {x.locus_id: x for x in r.stats.collect()}
        assert all(x.SA <= x.SB and x.NW == 2 and x.TW == 3 and x.SA + x.UM == x.SB - x.NR for x in s.values())
        assert r.chains.filter("wc > 2 or ws > 2 or we > 2").count() == 0
        assert before is None or all(s[k].SA <= before[k].SA for k in s)
        before = s


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "snp.gfa").write_text(texts()["snp"])
    lines = read_lines(spark, str(tmp_path / "in"))
    assert [r.value for r in lines.orderBy("line_pos").collect()] == [x for x in texts()["snp"].split("\n") if x]
    write_lines(lines, str(tmp_path / "out"))
    assert "\n".join(p.read_text() for p in sorted((tmp_path / "out").rglob("part-*"))) == texts()["snp"]
    assert next_context(0) == 200 and query_arguments("s", "c", 1, 2, raw=True)[-1] == "--raw"


def test_streaming_fold(spark, tmp_path):
    from walkloom.streaming.fold import start_fold, stream_walk_lines, streaming_edge_coverage, streaming_node_coverage

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "mixed.gfa").write_text(texts()["mixed"])
    w = stream_walk_lines(spark, str(tmp_path / "in")).filter("sample <> 'ref'")
    for counts, name, want in ((streaming_node_coverage(w), "nodes", {("30",): 2, ("3",): 3, ("1",): 5}), (streaming_edge_coverage(w), "edges", {("1", "2"): 5, ("30", "4"): 2})):
        start_fold(counts, name, str(tmp_path / name)).awaitTermination()
        got = {tuple(r[k] for k in r.asDict() if k in ("id", "a", "b")): r.wc for r in spark.table(name).collect()}
        assert all(got[k] == v for k, v in want.items())


def test_axis_and_walk_lists(spark):
    g = one(spark, texts()["mixed"])
    ax = axis.reference_axis(g, pick_reference(g, "ref"))
    assert axis.locus_window(ax).first().window_end == 141 and axis.order_breaks(ax).count() == 0
    anchors = spark.createDataFrame([("x", 0, 0.0), ("x", 100, 10.0), ("x", 200, 110.0)], "locus_id string, anchor_bp long, anchor_x double")
    points = spark.createDataFrame([("x", -10), ("x", 50), ("x", 150), ("x", 300)], "locus_id string, bp long")
    assert [r.x for r in axis.genomic_to_x(points, anchors).orderBy("bp").collect()] == [-1.0, 5.0, 60.0, 210.0]
    assert walks.walks_through(g.steps, g.segments.filter("id = '30'")).count() == 2
    assert walks.overlay_target(None, "n", "s", None) == ("node", "n") and walks.samples_in_order(g.walks).count() == 6
