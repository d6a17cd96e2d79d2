"""Genes and transcripts: parsing, lookup, search and the representative track."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkloom.functions.sequence import gene_window, unversioned

#: The contigs that a gene map keeps.
PRIMARY_CONTIGS = [f"chr{c}" for c in [*range(1, 23), "X", "Y", "M"]]


def read_gene_map(spark: SparkSession, path: str, ref: str) -> DataFrame:
    """A JSON object {symbol: [contig, start, end]} -> (ref, symbol, contig, start, end, pos); short entries skipped."""
    text = spark.read.text(path, wholetext=True)
    kinds = "map<string,array<string>>"
    rows = text.select(F.posexplode(F.map_entries(F.from_json("value", kinds))).alias("pos", "e")).select("pos", "e.key", "e.value").filter(F.size("value") >= 3)
    return rows.select(F.lit(ref).alias("ref"), F.col("key").alias("symbol"), F.get("value", F.lit(0)).alias("contig"), F.get("value", F.lit(1)).try_cast("long").alias("start"), F.get("value", F.lit(2)).try_cast("long").alias("end"), F.col("pos").cast("long").alias("pos"))


def gene_name(attributes: Column) -> Column:
    """GTF gene_name "X", else GFF gene_name=, gene=, Name= (URL-decoded)."""
    got = lambda p: F.nullif(F.regexp_extract(attributes, p, 1), F.lit(""))
    gff = F.coalesce(got(r"(?:^|;)\s*gene_name=([^;]+)"), got(r"(?:^|;)\s*gene=([^;]+)"), got(r"(?:^|;)\s*Name=([^;]+)"))
    return F.coalesce(got(r'gene_name "([^"]+)"'), F.try_url_decode(gff))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """GTF or GFF3, plain or .gz: genes on primary contigs, 0-based half-open, in the order of the lines."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.split("value", "\t").alias("f"), "value").filter(~F.col("value").startswith("#"))
    at = lambda i: F.get("f", F.lit(i))
    rows = lines.filter((F.size("f") >= 9) & (at(2) == "gene") & at(0).isin(*PRIMARY_CONTIGS))
    return rows.select("pos", gene_name(at(8)).alias("symbol"), at(0).alias("contig"), (at(3).try_cast("long") - 1).alias("start"), at(4).try_cast("long").alias("end")).filter("symbol is not null and start is not null and end is not null")


def longest_spans(genes: DataFrame) -> DataFrame:
    """One row per symbol: the longest span, the first of equals."""
    best = F.max_by(F.struct("contig", "start", "end"), F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("pos")).alias("p")))
    return genes.groupBy("symbol").agg(best.alias("g")).select("symbol", "g.*")


def gene_map_json(genes: DataFrame) -> DataFrame:
    """The map as one JSON text per symbol row: {"SYMBOL": [contig, start, end]}."""
    entry = F.concat(F.lit("["), F.to_json(F.array("contig")).substr(F.lit(2), F.length(F.to_json(F.array("contig"))) - 2), F.lit(","), F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit("]"))
    return genes.select("symbol", entry.alias("value"))


def by_symbol(genes: DataFrame) -> DataFrame:
    """Genes under their upper-case symbol; the last entry of a symbol counts."""
    return genes.groupBy("ref", F.upper("symbol").alias("key")).agg(F.max_by(F.struct("symbol", "contig", "start", "end"), "pos").alias("g")).select("ref", "key", "g.*")


def resolve_genes(genes: DataFrame, names: DataFrame) -> DataFrame:
    """names(name) -> exact matches, without regard to case and outer blanks."""
    return names.withColumn("key", F.upper(F.trim("name"))).join(by_symbol(genes), "key")


def gene_loci(genes: DataFrame, least: int = 20_000) -> DataFrame:
    """Adds the locus text of the padded window."""
    a, b = gene_window(F.col("start"), F.col("end"), least)
    return genes.withColumn("locus", F.concat(F.col("contig"), F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string")))


def search_genes(genes: DataFrame, query: str, most: int = 8) -> DataFrame:
    """Exact, then prefix, then infix matches, in code point order of the name inside each, over the whole table."""
    q = query.strip().upper()
    if not q:
        return by_symbol(genes).limit(0).withColumn("rank", F.lit(0))
    k = F.col("key")
    rank = F.when(k == q, 0).when(k.startswith(q), 1).when(k.contains(q), 2)
    return by_symbol(genes).withColumn("rank", rank).filter("rank is not null").orderBy("rank", "symbol", "ref").limit(most)


def wants_search(text: str) -> bool:
    """Whether typing should search: two characters at least, and no coordinates."""
    return len(text.strip()) >= 2 and not is_locus(text)


def is_locus(text: str) -> bool:
    return re.search(r":\s*[\d,]+\s*-\s*[\d,]+\s*$", text) is not None


def looks_like_locus(text: Column) -> Column:
    return text.rlike(r":\s*[\d,]+\s*-\s*[\d,]+\s*$")


def parse_loci(queries: DataFrame, column: str = "text", default_sample: str = "GRCh38") -> DataFrame:
    """Adds sample, contig, start, end and error: `contig:a-b`, commas allowed, `SAMPLE#hap#contig:a-b` too."""
    t = F.trim(F.col(column))
    parts = F.split(t, "#")
    three = F.size(parts) == 3
    rest = F.when(three, F.get(parts, F.lit(2))).otherwise(t)
    pattern = r"^([\w.]+):([\d,]+)\s*-\s*([\d,]+)$"
    number = lambda i: F.regexp_replace(F.regexp_extract(rest, pattern, i), ",", "").try_cast("long")
    ok = rest.rlike(pattern)
    error = F.when(~ok, F.concat(F.lit("Could not parse locus: "), F.col(column))).when(~F.coalesce(number(3) > number(2), F.lit(False)), F.lit("End must be greater than start."))
    return queries.select("*", F.when(three, F.get(parts, F.lit(0))).otherwise(default_sample).alias("sample"), F.when(ok, F.regexp_extract(rest, pattern, 1)).alias("contig"), F.when(ok, number(2)).alias("start"), F.when(ok, number(3)).alias("end"), error.alias("error"))


def parse_interval(text: Column) -> Column:
    """`a..b` as a struct, null unless there are exactly two numbers."""
    p = F.split(text, r"\.\.")
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    ok = (F.size(p) == 2) & a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$")
    return F.when(ok, F.struct(a.try_cast("long").alias("start"), b.try_cast("long").alias("end")))


# --- transcripts --------------------------------------------------------------------------------------------------


def column_order(auto_sql: str) -> dict[str, int]:
    """Field names of an autoSql description after chrom, chromStart and chromEnd, by place."""
    names = re.findall(r"^\s*[\w\[\]]+\s+(\w+)\s*;", auto_sql, re.M)
    return {n: i - 3 for i, n in enumerate(names) if i >= 3}


def transcripts(features: DataFrame, canonical: DataFrame, order: dict[str, int] | None = None) -> DataFrame:
    """features(locus_id, start, end, rest) with tab-separated rest columns -> transcripts with exons and flags;
    canonical(name) holds unversioned accessions."""
    place = {"name": 0, "strand": 2, "thickStart": 3, "thickEnd": 4, "blockSizes": 7, "chromStarts": 8, "name2": 9, "geneName": 14} | (order or {})
    f = F.split(F.coalesce("rest", F.lit("")), "\t")
    at = lambda n: F.get(f, F.lit(place[n]))
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)).cast("long"))
    name = F.coalesce(at("name"), F.lit(""))
    good = lambda c: F.when((c != "") & (c != name) & (c != "none"), c)
    sizes, starts = numbers(at("blockSizes")), numbers(at("chromStarts"))
    n = F.least(F.size(sizes), F.size(starts))
    exons = F.transform(F.arrays_zip(F.slice(starts, F.lit(1), n).alias("s"), F.slice(sizes, F.lit(1), n).alias("z")), lambda e: F.struct((F.col("start") + e["s"]).alias("start"), (F.col("start") + e["s"] + e["z"]).alias("end")))
    as_number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("long")
    flags = canonical.select(F.col("name").alias("c_name"), F.lit(True).alias("flag")).distinct()
    t = features.select("*", name.alias("name"), F.coalesce(good(at("geneName")), good(at("name2")), name).alias("symbol"), F.when(at("strand") == "-", "-").otherwise("+").alias("strand"), as_number(at("thickStart")).alias("cds_start"), as_number(at("thickEnd")).alias("cds_end"), exons.alias("exons"))
    return t.join(flags, unversioned(F.col("name")) == F.col("c_name"), "left").withColumn("canonical", F.col("flag").isNotNull()).drop("c_name", "flag", "rest")


def representative_transcripts(t: DataFrame, key: list[str], pos: str) -> DataFrame:
    """One per symbol: canonical, then longest coding span, then longest, then first."""
    w = Window.partitionBy(*key).orderBy(F.col("canonical").desc(), (F.col("cds_end") - F.col("cds_start")).desc(), (F.col("end") - F.col("start")).desc(), pos)
    return t.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pack_lanes(labels: DataFrame, gap: float = 6.0, most: int = 4) -> DataFrame:
    """labels(locus_id, pos, x0, x1) -> lane of each: the first whose last label ends `gap` before; the last lane if
    none. One ordered fold per locus."""
    items = labels.groupBy("locus_id").agg(F.array_sort(F.collect_list(F.struct("x0", "pos", "x1"))).alias("i"))
    start = F.struct(F.array_repeat(F.lit(float("-inf")), most).alias("ends"), F.array().cast("array<struct<pos:long,lane:int>>").alias("out"))

    def put(acc: Column, i: Column) -> Column:
        free = F.array_position(F.transform(acc["ends"], lambda e: e + gap <= i["x0"]), F.lit(True)).cast("int")
        lane = F.when(free > 0, free).otherwise(F.lit(most))
        ends = F.transform(acc["ends"], lambda e, k: F.when(k + 1 == lane, F.greatest(e, i["x1"].cast("double"))).otherwise(e))
        return F.struct(ends.alias("ends"), F.concat(acc["out"], F.array(F.struct(i["pos"].cast("long").alias("pos"), (lane - 1).cast("int").alias("lane")))).alias("out"))

    return items.select("locus_id", F.explode(F.aggregate("i", start, put)["out"]).alias("o")).select("locus_id", "o.pos", "o.lane")
