"""Display functions and the tables of the views."""

from pyspark.sql import functions as F

from walkloom.functions import display as dp
from walkloom.operators import views
from walkloom.plans.report import graph_complexity
from walkloom.sources import gfa

TEXT = "\n".join(
    ["H\tVN:Z:1.1\tRS:Z:ref"] + [f"S\t{i}\t{'ACGT' * (3 * i)}" for i in range(1, 9)] + ["S\tu9\tAC\tMB:Z:a,b,c,d,e\tWC:i:1200"]
    + [f"L\t{i}\t+\t{i + 1}\t-\t0M" for i in range(1, 8)]
    + ["W\tref\t0\tc\t0\t100\t" + "".join(f">{i}" for i in range(1, 9)), "W\tunknown\t1\tc\t5\t9\t>1<2", "W\tunknown\t2\tc\t0\t8\t>2>1>2", "W\tx\t1\tc\t0\t1\t>3", "W\tunknown\t1\tc\t0\t7\t>1>2"]
)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_texts(spark):
    got = [one(spark, c) for c in (
        dp.percent_text(F.lit(0.256)), dp.size_text(F.lit(1000)), dp.size_text(F.lit(1500)), dp.size_text(F.lit(5_000_000)), dp.size_text(F.lit(3 << 30)),
        dp.depth_text(F.lit(3.25), F.lit("x")), dp.depth_text(F.lit(12345.6), F.lit("reads")), dp.coordinate_text(F.lit("chr5"), F.lit(1000), F.lit(2500000)),
        dp.members_preview(F.array(*[F.lit(x) for x in "abcde"])), dp.members_preview(F.array(F.lit("a"))), dp.sequence_preview(F.lit("A" * 41)), dp.sequence_preview(F.lit("A" * 40)),
    )]
    assert got[:5] == ["26%", "1000 B", "1 KiB", "4.8 MiB", "3.0 GiB"]
    assert got[5] in ("3.3×", "3.2×") and got[6:8] == ["12,346 reads", "chr5:1,000–2,500,000"]
    assert got[8:] == ["a,b,c +2 more", "a", "A" * 40 + "…", "A" * 40]


def by_hand(stops, window, ratio):
    x = (window[0] + min(1, max(0, ratio)) * (window[1] - window[0])) * (len(stops) - 1)
    i = min(int(x), len(stops) - 2)
    return "rgb(" + ", ".join(str(int(a + (b - a) * (x - i) + 0.5)) for a, b in zip(stops[i], stops[i + 1])) + ")"


def test_colours(spark):
    for mode, stops in (("length", dp.VIRIDIS), ("bubbleSize", dp.PLASMA)):
        for theme in ("dark", "light"):
            for ratio in (-1.0, 0.0, 0.3, 0.5, 0.99, 1.0, 7.0):
                assert one(spark, dp.mode_colour(mode, F.lit(ratio), theme)) == by_hand(stops, dp.WINDOWS[mode][theme], ratio)
    assert one(spark, dp.mode_colour("coverage", F.lit(0.5))) == "rgb(235, 122, 20)" and one(spark, dp.mode_colour("coverage", F.lit(0.0), "light")) == "rgb(214, 158, 0)"
    legend = one(spark, dp.legend_gradient("coverage"))
    assert legend.startswith("linear-gradient(90deg, rgb(255, 214, 10), ") and legend.count("rgb(") == 9

    def hue(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        h = h - (1 << 32) if h >= 1 << 31 else h
        return abs(h) * 137.508 % 360

    for text in ("1", "u17", "node-12345678901"):
        assert abs(one(spark, dp.hue_of_text(F.lit(text))) - hue(text)) < 1e-4
    assert one(spark, dp.nth_colour(F.lit(1))) == "hsl(137.508, 68%, 55%)" and one(spark, dp.text_colour(F.lit(""), 42)) == "hsl(0.0, 65%, 42%)"
    theme = {"A": "a", "C": "c", "G": "g", "T": "t", "other": "o"}
    assert [one(spark, dp.base_colour(F.lit(b), theme)) for b in "AcGtuN"] == ["a", "c", "g", "t", "t", "o"]


def test_previews_labels_and_paths(spark):
    g = gfa.parse(gfa.lines_of(spark, {"L": TEXT})).stored()
    walks = views.preview_walks(g, 2).orderBy("walk_pos").collect()
    assert [(w.sample, w.steps, w.path) for w in walks] == [("ref", 8, ">1>2>3>4>5>6…"), ("unknown", 2, ">1<2")]
    segs = views.preview_segments(g).orderBy("seg_pos").collect()
    assert len(segs) == 9 and segs[8].members == "a,b,c +2 more" and segs[8].walks == 1200 and segs[0].members == "—" and segs[7].seq == "ACGT" * 10 + "…"
    assert views.preview_links(g, 1).collect()[0][2:] == ("+1", "-2")
    labels = {r.walk_pos: (r.label, r.row_label) for r in views.labelled_walks(g).collect()}
    assert sorted(labels.values()) == [("Walk 1", "non-reference walk"), ("Walk 2", "non-reference walk"), ("ref", "ref (hap 0)")]
    ends = {(r.label, r.length, r.role) for r in views.labelled_endpoints(g, "2").collect()}
    assert ends == {("hap 1", 4, "end"), ("hap 2", 8, "both"), ("hap 1", 7, "end")}
    path = views.straightened_path(g, "unknown", 2, "c").orderBy("step_pos").collect()
    assert [r.id for r in path] == ["2", "1", "2"]
    traced = g.walks.filter("hap = 2")
    assert {r.id for r in views.exit_highlight(g.steps, traced).collect()} == {"1", "2"} and views.exit_highlight(g.steps).count() == 0
    bubble = spark.createDataFrame([("L", ["4", "5", "4"])], "locus_id string, members array<string>")
    assert {r.id for r in views.exit_highlight(g.steps, traced, bubble).collect()} == {"4", "5"}
    assert views.overlays(None, traced, traced).count() == 2 and views.overlays(traced.limit(0), traced, traced).count() == 1


def test_tracks_colours_and_reports(spark):
    kind = "locus_id string, contig string, symbol string, pos long, start long, end long, cds_start long, cds_end long, canonical boolean"
    t = spark.createDataFrame([("L", "c", "A", 0, 10, 50, 10, 20, False), ("L", "c", "A", 1, 30, 45, 30, 31, True), ("L", "c", "B", 2, 5, 12, 5, 6, False), ("L", "c", "C", 3, 100, 120, 1, 2, True), ("L", "d", "D", 4, 10, 20, 1, 2, True)], kind)
    window = spark.createDataFrame([("L", "c", 8, 100)], "locus_id string, contig string, window_start long, window_end long")
    assert [(r.symbol, r.pos) for r in views.gene_track(t, window).orderBy("place").collect()] == [("B", 2), ("A", 1)]
    g = gfa.parse(gfa.lines_of(spark, {"L": TEXT})).stored()
    backbone = g.segments.filter("id in ('7', '8')")
    cov = g.steps.groupBy("locus_id", "id").agg(F.count_distinct("walk_pos").alias("coverage"))
    most = views.normalisers(g.segments, backbone, cov, spark.createDataFrame([], "locus_id string, longest long"))
    assert tuple(most.first())[1:] == (72, 4, 0)
    nodes = g.segments.select("locus_id", "id", F.col("length").alias("value"))
    colours = {r.id: r for r in views.node_colours(nodes, backbone, most.select("locus_id", F.col("max_segment_length").alias("most")), "length").collect()}
    assert colours["7"].colour == "#334155" and colours["6"].ratio == 1.0 and colours["6"].colour == "rgb(253, 231, 37)"
    rows = views.report_rows(graph_complexity(g, "ref"), spark.createDataFrame([("L", 5_000_000, 12)], "locus_id string, bytes long, blocks long")).orderBy("place").collect()
    assert [(r.item, r.value) for r in rows] == [("fetched", "4.8 MiB in 12 blocks"), ("nodes", "9"), ("links", "7"), ("walks", "5"), ("reference span", "100 bp"), ("sequence shown", "434 bp")]
    comp = spark.createDataFrame([("L", x, c) for x, c in (("b", "a"), ("a", "a"), ("z", "y"), ("y", "y"), ("x", "x"))], "locus_id string, id string, component string")
    assert [(r.number, r.place, r.id) for r in views.components_in_order(comp).orderBy("number", "place").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "x"), (2, 0, "y"), (2, 1, "z")]
    lengths = spark.createDataFrame([("L", i, n) for i, n in (("a", 5), ("b", 1), ("x", 6), ("y", 9))], "locus_id string, id string, length long")
    assert [(r.component, r.total_bp) for r in views.backbones_in_order(comp, lengths).orderBy("rank").collect()] == [("y", 9), ("a", 6), ("x", 6)]
