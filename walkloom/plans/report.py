"""Reports: graph statistics, complexity, the machine-readable answer to a query, guards and link writers."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.model import Graph
from walkloom.operators.walks import real_walks

#: The graphs that queries may name.
REFERENCES = {"GRCh38": "HPRC v2.1, GRCh38-based", "CHM13": "HPRC v2.1, CHM13-based"}


def gfa_stats(g: Graph, reference_sample: str | None = None) -> DataFrame:
    """(locus_id, segments, links, walks, total_sequence_bp, samples, walk_records, reference_path_bp). A reduced
    locus takes walks and samples from its counters; walk_records is null elsewhere."""
    s = g.segments.groupBy("locus_id").agg(F.count("*").alias("segments"), F.sum("length").alias("total_sequence_bp"))
    l = g.links.groupBy("locus_id").agg(F.count("*").alias("links"))  # noqa: E741
    w = real_walks(g.walks).groupBy("locus_id").agg(F.count("*").alias("walks"), F.count_distinct("sample").alias("samples"))
    out = s.join(l, "locus_id", "left").join(w, "locus_id", "left")
    if reference_sample is not None:
        first = g.walks.filter(F.col("sample") == reference_sample).groupBy("locus_id").agg(F.min_by(F.col("end") - F.col("start"), "walk_pos").alias("reference_path_bp"))
        out = out.join(first, "locus_id", "left")
    else:
        out = out.withColumn("reference_path_bp", F.lit(None).cast("long"))
    if g.stats is not None:
        out = out.join(g.stats.select("locus_id", "TW", "NS", "WR"), "locus_id", "left")
    else:
        out = out.withColumns({t: F.lit(None).cast("long") for t in ("TW", "NS", "WR")})
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("locus_id", "segments", zero("links").alias("links"), F.coalesce("TW", zero("walks")).alias("walks"), "total_sequence_bp", F.coalesce("NS", zero("samples")).alias("samples"), F.col("WR").alias("walk_records"), F.col("reference_path_bp").cast("long").alias("reference_path_bp"))


def graph_complexity(g: Graph, reference_sample: str | None = None) -> DataFrame:
    s = gfa_stats(g, reference_sample).drop("TW")
    if g.stats is not None:
        s = s.join(g.stats.select("locus_id", *[F.col(t).alias(f"x_{t}") for t in ("SB", "LB", "ST", "SN", "NR", "BR", "UM")]), "locus_id", "left")
    else:
        s = s.withColumns({f"x_{t}": F.lit(None).cast("long") for t in ("SB", "LB", "ST", "SN", "NR", "BR", "UM")})
    zero = lambda t: F.coalesce(f"x_{t}", F.lit(0).cast("long"))
    return s.select(
        "locus_id", F.col("segments").alias("nodes"), zero("SB").alias("nodes_before"), "links", zero("LB").alias("links_before"), "walks", "walk_records", "total_sequence_bp", "reference_path_bp",
        zero("ST").alias("variant_sites"), zero("SN").alias("snps"), zero("NR").alias("nodes_removed"), zero("BR").alias("bases_removed"), zero("UM").alias("unchop_merges"), F.col("x_SB").isNotNull().alias("simplified"),
    )


def api_report(complexity: DataFrame, queries: DataFrame) -> DataFrame:
    """(locus_id, json): {"ok": true, "query": .., "complexity": ..}; queries with an error give {"ok": false, ..}.
    queries(locus_id, sample, contig, start, end, context, error)."""
    q = F.struct("sample", "contig", "start", "end", "context")
    rest = [c for c in complexity.columns if c != "locus_id"]
    x = queries.join(complexity.select("locus_id", F.struct(*rest).alias("complexity")), "locus_id", "left")
    error = F.coalesce("error", F.when(F.col("complexity").isNull(), "No graph for this locus."))
    good = F.to_json(F.struct(F.lit(True).alias("ok"), q.alias("query"), F.col("complexity")), {"ignoreNullFields": "false"})
    bad = F.to_json(F.struct(F.lit(False).alias("ok"), error.alias("error"), q.alias("query")))
    return x.select("locus_id", F.when(error.isNull(), good).otherwise(bad).alias("json"))


def validate_queries(queries: DataFrame) -> DataFrame:
    """queries(ref, locus, gene, context) with `error` for an unknown reference, a bad context, or no locus."""
    context = F.coalesce(F.col("context").try_cast("double"), F.lit(float("nan")))
    error = (
        F.when(~F.coalesce(F.col("ref").isin(*REFERENCES), F.lit(False)), F.concat(F.lit("Unknown reference: "), F.coalesce("ref", F.lit(""))))
        .when(F.col("context").isNotNull() & (F.isnan(context) | (context < 0) | (F.abs(context) == float("inf"))), "Context must be a number of bases, 0 or more.")
        .when(F.coalesce("locus", "gene").isNull(), "Name a locus or a gene.")
    )
    return queries.withColumn("error", error)


def walk_load_tier(nodes: Column, records: Column, narrow: bool = False, low_memory: bool = False) -> Column:
    """How the full walks may be loaded: risky, auto or manual; the bars depend on the device."""
    most_records, most_nodes = (25_000 if low_memory else 250_000), (8_000 if narrow else 25_000)
    auto_records, auto_nodes = (6_000 if narrow else 20_000), (2_000 if narrow else 6_000)
    risky = (records > most_records) | (nodes > most_nodes)
    return F.when(risky, "risky").when((nodes <= auto_nodes) & (records <= auto_records), "auto").otherwise("manual")


def next_context(context: int) -> int:
    """Twice the context; from none to 200."""
    return context * 2 if context else 200


def share_link(base: Column, ref: Column, gene: Column, locus: Column, context: Column, default_context: int = 100) -> Column:
    """ref and locus (the gene if there is one); context only where it is not the default."""
    where = F.url_encode(F.coalesce(gene, locus))
    return F.concat(base, F.lit("?ref="), ref, F.lit("&locus="), where, F.when(context != default_context, F.concat(F.lit("&context="), context.cast("string"))).otherwise(F.lit("")))


def read_parameters(url: Column) -> dict[str, Column]:
    """ref, locus, gene and context of a link."""
    return {k: F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(k))) for k in ("ref", "locus", "gene", "context")}


def query_arguments(sample: str, contig: str, start: int, end: int, context: int = 100, max_variant: int | None = 50, raw: bool = False) -> list[str]:
    """Command-line arguments of a locus query; raw graphs have no size limit."""
    args = ["--sample", sample, "--contig", contig, "--interval", f"{start}..{end}", "--context", str(context)]
    return [*args, "--raw"] if raw else [*args, *(["--max-variant", str(max_variant)] if max_variant is not None else [])]


def link_of(ref: str, locus: str, context: int | None = None) -> str:
    return f"?ref={quote(ref)}&locus={quote(locus)}" + (f"&context={context}" if context not in (None, 100) else "")


def query_report(complexity: DataFrame) -> DataFrame:
    """Long form: (locus_id, item, value)."""
    items = [c for c in complexity.columns if c not in ("locus_id", "simplified")]
    return complexity.unpivot(["locus_id"], items, "item", "value")


def is_sample_name(text: str) -> bool:
    return re.fullmatch(r"[\w.\-]+", text) is not None
