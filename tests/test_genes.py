import gzip
import json

from pyspark.sql import functions as F

from walkloom.functions import sequence as sq
from walkloom.operators import genes
from walkloom.operators.axis import reference_axis
from walkloom.operators.iterate import bfs_hops, weighted_reach
from walkloom.operators.layout import MODES, layout, metric_ratio
from walkloom.plans import report


def test_annotation_and_gene_map(spark, tmp_path):
    gtf = "#c\nchr1\tx\tgene\t101\t200\t.\t+\t.\tgene_id \"g\"; gene_name \"ABC\";\nchr1\tx\tgene\t1\t500\t.\t+\t.\tgene_name \"ABC\";\nchr1\tx\texon\t1\t900\t.\t+\t.\tgene_name \"ABC\";\nchrUn\tx\tgene\t1\t9\t.\t+\t.\tgene_name \"N\";\nchrX\tx\tgene\t5\t9\t.\t+\t.\tID=1;Name=a%20b;\n"
    with gzip.open(tmp_path / "a.gtf.gz", "wt") as f:
        f.write(gtf)
    got = {r.symbol: (r.contig, r.start, r.end) for r in genes.longest_spans(genes.read_annotation(spark, str(tmp_path / "a.gtf.gz"))).collect()}
    assert got == {"ABC": ("chr1", 0, 500), "a b": ("chrX", 4, 9)}
    (tmp_path / "m.json").write_text(json.dumps({"Smn1": ["chr5", 100, 30100], "short": ["x"], "smn12": ["chr5", 5, 6], "ASMN1": ["chr2", 7, 9], "SMN1": ["chr5", 100, 200]}))
    m = genes.read_gene_map(spark, str(tmp_path / "m.json"), "GRCh38")
    assert m.count() == 4
    assert [(r.key, r.rank) for r in genes.search_genes(m, "smn1").collect()] == [("SMN1", 0), ("SMN12", 1), ("ASMN1", 2)]
    hit = genes.gene_loci(genes.resolve_genes(m, spark.createDataFrame([(" smn1 ",)], "name string"))).first()
    assert hit.locus == "chr5:0-10150" and genes.wants_search("sm") and not genes.wants_search("chr1:5-9") and not genes.wants_search("s")
    line = genes.gene_map_json(genes.longest_spans(m)).filter("symbol = 'ASMN1'").first().value
    assert json.loads(line) == ["chr2", 7, 9]


def test_transcripts(spark):
    rest = lambda name, strand, a, b, sizes, starts, two, gene: "\t".join([name, "0", strand, str(a), str(b), "0", "2", sizes, starts, two, "", "", "", "", gene])
    rows = [("x", 100, 400, rest("NM_1.2", "-", 110, 300, "10,20,", "0,50,", "none", "GENE"), 0), ("x", 50, 900, rest("NM_2.1", "+", 60, 800, "5", "0,9", "GENE", ""), 1), ("x", 0, 9, rest("NM_3", "+", "q", 8, "", "", "NM_3", "none"), 2)]
    t = genes.transcripts(spark.createDataFrame(rows, "locus_id string, start long, end long, rest string, pos int"), spark.createDataFrame([("NM_1",)], "name string"))
    by = {r.name: r for r in t.collect()}
    assert by["NM_1.2"].canonical and by["NM_1.2"].strand == "-" and [(e.start, e.end) for e in by["NM_1.2"].exons] == [(100, 110), (150, 170)]
    assert by["NM_2.1"].symbol == "GENE" and len(by["NM_2.1"].exons) == 1 and by["NM_3"].symbol == "NM_3" and by["NM_3"].cds_start == 0
    assert sorted(r.name for r in genes.representative_transcripts(t, ["locus_id", "symbol"], "pos").collect()) == ["NM_1.2", "NM_3"]
    order = genes.column_order('table x\n"d"\n(\n string chrom; "c"\n uint chromStart; "s"\n uint chromEnd; "e"\n string name; "n"\n uint score; "s"\n char[1] strand; "t"\n)')
    assert order == {"name": 0, "score": 1, "strand": 2}
    lanes = genes.pack_lanes(spark.createDataFrame([("x", 0, 0.0, 50.0), ("x", 1, 10.0, 30.0), ("x", 2, 40.0, 60.0), ("x", 3, 57.0, 70.0)], "locus_id string, pos long, x0 double, x1 double"))
    assert [r.lane for r in lanes.orderBy("pos").collect()] == [0, 1, 1, 0]


def test_loci_and_reports(spark):
    q = spark.createDataFrame([("chr6:31,972,046-32,055,647",), ("CHM13#0#chr1:5-9",), ("chr1:9-5",), ("nonsense",)], "text string")
    r = genes.parse_loci(q).collect()
    assert (r[0].sample, r[0].contig, r[0].start, r[0].end, r[0].error) == ("GRCh38", "chr6", 31972046, 32055647, None)
    assert (r[1].sample, r[1].start) == ("CHM13", 5) and r[2].error and r[3].error
    iv = spark.createDataFrame([("5..9",), ("5..",), ("1..2..3",)], "t string").select(genes.parse_interval(F.col("t")).alias("i")).collect()
    assert (iv[0].i.start, iv[0].i.end) == (5, 9) and iv[1].i is None and iv[2].i is None
    bad = report.validate_queries(spark.createDataFrame([("GRCh38", "chr1:1-2", None, "10"), ("x", "a", None, None), ("CHM13", None, None, None), ("CHM13", "a", None, "-1"), ("CHM13", None, "g", "z")], "ref string, locus string, gene string, context string"))
    assert [x.error is None for x in bad.collect()] == [True, False, False, False, False]
    url = spark.createDataFrame([("http://h/p?ref=GRCh38&locus=chr1%3A5-9",)], "u string").select(*[c.alias(k) for k, c in report.read_parameters(F.col("u")).items()]).first()
    assert (url.ref, url.locus, url.gene) == ("GRCh38", "chr1:5-9", None)
    link = spark.range(1).select(report.share_link(F.lit("/"), F.lit("GRCh38"), F.lit(None).cast("string"), F.lit("chr1:5-9"), F.lit(200)).alias("l")).first().l
    assert link == "/?ref=GRCh38&locus=chr1%3A5-9&context=200" and report.link_of("a", "b:1") == "?ref=a&locus=b%3A1"
    c = spark.createDataFrame([("x", 3, True)], "locus_id string, nodes long, simplified boolean")
    asked = spark.createDataFrame([("x", "s", "c", 1, 2, 100, None), ("y", "s", "c", 1, 2, 100, "broken")], "locus_id string, sample string, contig string, start long, end long, context long, error string")
    out = {r.locus_id: json.loads(r.json) for r in report.api_report(c, asked).collect()}
    assert out["x"]["ok"] and out["x"]["complexity"]["nodes"] == 3 and out["y"] == {"ok": False, "error": "broken", "query": {"sample": "s", "contig": "c", "start": 1, "end": 2, "context": 100}}


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert [get(sq.revcomp(F.lit(s))) for s in ("AAAC", "ACGT", "acgt", "N", "Uu")] == ["GTTT", "ACGT", "acgt", "N", "AA"]
    assert get(sq.oriented(F.lit("aaacccgg"), F.lit(True))) == "CCGGGTTT"
    assert get(sq.fnv1a(F.lit("foobar"))) == 0xBF9CF968 and abs(get(sq.mulberry32(F.lit(0).cast("long"))) - 0.26642920868471265) < 1e-15
    assert -0.5 <= get(sq.stable_unit(F.lit("n1"))) < 0.5 and get(sq.hash31(F.lit("ab"))) == 97 * 31 + 98
    assert get(sq.coverage_rgb(F.lit(1), F.lit(10))) == "rgb(255,214,10)" and get(sq.coverage_rgb(F.lit(10), F.lit(10))) == "rgb(214,30,30)"
    assert get(sq.trace_key(F.array(F.lit("b"), F.lit("a")))) == "a>b" and get(sq.cell_signature(F.array(F.lit(None), F.lit(""), F.lit("A")))) == ".|?|A"
    assert get(sq.preview(F.array(*[F.lit(str(i)) for i in range(5)]), 3)) == "0, 1, 2, +2 more" and get(sq.heat_colour(F.lit(0.0))) == "rgb(68, 1, 84)"
    assert get(sq.format_bp(F.lit(1500))) == "1.5 kb" and get(sq.format_percent(F.lit(0.25))) == "25.0%"
    sq.register(spark)
    assert spark.sql("select revcomp('AAC') as a, size(walk_steps('>1<u2')) as b, unversioned('x.1') as c").first() == ("GTT", 2, "x")


def test_reach_and_layouts(spark):
    from fixtures import texts

    from walkloom.model import pick_reference
    from walkloom.sources.gfa import lines_of, parse

    g = parse(lines_of(spark, {"x": texts()["mixed"]})).stored()
    adj = g.links.selectExpr("locus_id", "from_id as a", "to_id as b").union(g.links.selectExpr("locus_id", "to_id", "from_id"))
    src = spark.createDataFrame([("x", "3", 0.0)], "locus_id string, id string, dist double")
    assert {r.id for r in weighted_reach(adj, src, g.segments, 5).collect()} == {"2", "3", "4"}
    assert {r.id: r.hops for r in bfs_hops(adj, src.select("locus_id", "id"), 2).collect()} == {"3": 0, "2": 1, "4": 1, "1": 2, "20": 2, "5": 2, "30": 2}
    ax = reference_axis(g, pick_reference(g, "ref"))
    for mode in MODES:
        pos = {r.id: (r.x, r.y) for r in layout(g.segments, g.links, ax, mode, rounds=10).collect()}
        assert len(pos) == 7 and len(set(pos.values())) == 7 and all(abs(v) < 1e6 for p in pos.values() for v in p)
    assert max(r.ratio for r in metric_ratio(g.segments, "length").collect()) == 1.0
