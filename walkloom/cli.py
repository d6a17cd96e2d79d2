"""The command line: a locus, or a gene, of a stored graph as graph text.

    python -m walkloom.cli --graph DIR --sample GRCh38 --contig chr5 --interval 70925000..70953000 [--context 100]
                           [--max-variant 50 | --raw] [--out DIR]
    python -m walkloom.cli --graph DIR --genes TABLE --gene SMN1 ... resolves the gene and widens its window to 20 kb.
    python -m walkloom.cli --graph DIR --store LINES ... stores a graph text for later queries.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom.model import Graph
from walkloom.operators.genes import gene_loci
from walkloom.plans.reduce import reduce_graph, reduced_lines
from walkloom.sources import gfa, stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="walkloom", description="Query a stored variation graph by locus or gene.")
    p.add_argument("--graph", required=True, help="folder of the stored graph")
    p.add_argument("--sample", default="GRCh38", help="reference sample")
    p.add_argument("--contig")
    p.add_argument("--interval", type=interval, help="START..END in bases of the reference")
    p.add_argument("--gene", help="a symbol of --genes in place of --contig and --interval")
    p.add_argument("--genes", help="Parquet table ref, symbol, contig, start, end, pos")
    p.add_argument("--context", type=whole, default=100, help="bases around the locus (100)")
    p.add_argument("--max-variant", type=whole, default=50, help="sites up to this size are simplified (50)")
    p.add_argument("--raw", action="store_true", help="the subgraph as it is")
    p.add_argument("--store", help="graph text to store at --graph first")
    p.add_argument("--out", help="folder for the text; printed otherwise")
    return p


def whole(text: str) -> int:
    if not text.isdigit():
        raise argparse.ArgumentTypeError(f"not a whole number: {text}")
    return int(text)


def interval(text: str) -> tuple[int, int]:
    a, dots, b = text.partition("..")
    if not dots or not a.isdigit() or not b.isdigit() or int(a) >= int(b):
        raise argparse.ArgumentTypeError(f"not START..END with START before END: {text}")
    return int(a), int(b)


def raw_lines(g: Graph) -> DataFrame:
    """A graph's tables as text lines (locus_id, line_pos, value): header, segments, links, walks."""
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    head = g.headers.select("locus_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("H\tVN:Z:1.1\tRS:Z:"), F.array_join("reference_samples", " ")).alias("value"))
    seg = g.segments.select("locus_id", F.lit(1).alias("kind"), F.col("seg_pos").alias("pos"), F.concat_ws("\t", F.lit("S"), "id", F.when(F.coalesce("seq", F.lit("")) != "", F.col("seq")).otherwise("*"), F.when(F.coalesce("seq", F.lit("")) == "", F.concat(F.lit("LN:i:"), F.col("length").cast("string")))).alias("value"))
    link = g.links.select("locus_id", F.lit(2).alias("kind"), F.col("link_pos").alias("pos"), F.concat_ws("\t", F.lit("L"), "from_id", sign("from_rev"), "to_id", sign("to_rev"), F.lit("0M")).alias("value"))
    path = g.steps.groupBy("locus_id", "walk_pos").agg(F.array_sort(F.collect_list(F.struct("step_pos", "id", "rev"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(F.when(x["rev"], "<").otherwise(">"), x["id"])), "")
    walk = g.walks.join(path, ["locus_id", "walk_pos"]).select("locus_id", F.lit(3).alias("kind"), F.col("walk_pos").alias("pos"), F.concat_ws("\t", F.lit("W"), "sample", F.col("hap").cast("string"), "seq_id", F.col("start").cast("string"), F.col("end").cast("string"), text, F.when(F.col("weight") != 1, F.concat(F.lit("WT:i:"), F.col("weight").cast("string")))).alias("value"))
    return head.unionByName(seg).unionByName(link).unionByName(walk).select("locus_id", (F.shiftleft(F.col("kind").cast("long"), 60) + F.col("pos")).alias("line_pos"), "value")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """The lines of the answer, in order; None where a graph was stored and nothing asked."""
    if args.store:
        g = gfa.parse(gfa.read_lines(spark, args.store, "graph"))
        refs = g.walks.filter(F.col("sample") == args.sample).select("locus_id", "walk_pos", "sample", F.col("seq_id").alias("contig"))
        stored.store_graph(g, refs, args.graph)
    contig, span = args.contig, args.interval
    if args.gene:
        if not args.genes:
            raise SystemExit("--gene needs --genes")
        found = gene_loci(spark.read.parquet(args.genes).filter(F.upper("symbol") == args.gene.upper()).filter(F.col("ref") == args.sample)).select("locus").first()
        if found is None:
            raise SystemExit(f"No gene {args.gene}.")
        contig, _, place = found.locus.partition(":")
        span = tuple(int(x) for x in place.split("-"))
    if not contig or not span:
        if args.store:
            return None
        raise SystemExit("Name --contig and --interval, or --gene.")
    g = stored.read_locus(spark, args.graph, args.sample, contig, *span, context=args.context).stored()
    if args.raw:
        return raw_lines(g).orderBy("line_pos")
    return reduced_lines(reduce_graph(gfa.parse(raw_lines(g), strict=True), args.max_variant)).orderBy("line_pos")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("walkloom").getOrCreate()
    lines = run(spark, args)
    if lines is None:
        return
    if args.out:
        gfa.write_lines(lines, args.out)
    else:
        for row in lines.toLocalIterator():
            print(row["value"])


if __name__ == "__main__":
    main()
