"""GFA text to typed tables and back.

Two readings of the same text exist and differ (ids, elided sequences, path lines, repeated segments): `strict` is
the reading of the reducer, `viewer` that of the graph views. Parsing is column expressions only.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkloom.functions.sequence import path_steps, walk_steps
from walkloom.model import STAT_TAGS, Graph

# --- lines --------------------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, locus: str | None = None) -> DataFrame:
    """(locus_id, line_pos, value): a locus is a file, or the folder locus_id=.. that `write_lines` makes, unless named.

    line_pos orders lines by file (of a folder or a name), split and place in the split, without a shuffle: Spark never
    cuts splits shorter than the smaller of its two size settings, so that quantum tells splits apart, and ids within a
    task grow along a split."""
    lines = spark.read.text(path)
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    quantum = max(1, min(as_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes")))
    name = F.col("_metadata.file_name")
    if locus:
        files = sorted(unquote(f.rsplit("/", 1)[-1]) for f in lines.inputFiles())
        number = F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (f, i)]) if files else None
        order = F.coalesce(number[name], number[F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))]) if files else F.lit(0)
        order, owner = F.coalesce(order, F.lit(0)), F.lit(locus)
    elif "locus_id" in lines.columns:
        order, owner = F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("int"), F.lit(0)), F.col("locus_id").cast("string")
    else:
        order, owner = F.lit(0), F.regexp_replace(name, r"\.gfa(\.gz)?$", "")
    block = F.floor(F.col("_metadata.file_block_start") / F.lit(quantum)).cast("long")
    place = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    fits = (order < 1 << 11) & (block < 1 << 20) & (place < 1 << 32)
    line_pos = F.shiftleft(order.cast("long"), 52) + F.shiftleft(block, 32) + place
    line_pos = F.when(fits, line_pos).otherwise(F.raise_error(F.lit("more files, splits or lines than places")).cast("long"))
    return lines.select(owner.alias("locus_id"), line_pos.alias("line_pos"), "value").filter(F.col("value") != "")


def lines_of(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Lines of texts by locus."""
    df = spark.createDataFrame(list(texts.items()), "locus_id string, text string")
    return df.select("locus_id", F.posexplode(F.split("text", "\n")).alias("line_pos", "value")).withColumn("line_pos", F.col("line_pos").cast("long")).filter(F.col("value") != "")


# --- fields and tags ----------------------------------------------------------------------------------------------


def _tag(fields: Column, prefix: str) -> Column:
    return F.get(F.filter(fields, lambda x: x.startswith(prefix)), F.lit(0))


def string_tag(fields: Column, tag: str) -> Column:
    return F.substr(_tag(fields, f"{tag}:Z:"), F.lit(len(tag) + 4))


def int_tag(fields: Column, tag: str) -> Column:
    return F.substr(_tag(fields, f"{tag}:i:"), F.lit(len(tag) + 4)).try_cast("double").cast("long")


def float_tag(fields: Column, tag: str) -> Column:
    x = F.substr(_tag(fields, f"{tag}:f:"), F.lit(len(tag) + 4)).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(text: Column) -> Column:
    """Digits only, else null; beyond 64 bits null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("decimal(20,0)")).try_cast("long")


def walk_weight(fields: Column) -> Column:
    """The first readable WT:i tag after the walk, else 1."""
    got = F.transform(F.filter(F.slice(fields, 8, 1 << 20), lambda x: x.startswith("WT:i:")), lambda x: number(F.substr(x, F.lit(6))))
    return F.coalesce(F.get(F.filter(got, lambda x: x.isNotNull()), F.lit(0)), F.lit(1).cast("long"))


def _rest(fields: Column, first: int) -> Column:
    return F.slice(fields, first, 1 << 20)


# --- tables -------------------------------------------------------------------------------------------------------


def parse(lines: DataFrame, strict: bool = False) -> Graph:
    """lines(locus_id, line_pos, value) -> tables."""
    rows = lines.withColumn("f", F.split("value", "\t")).withColumn("kind", F.get("f", F.lit(0)))
    if strict:
        rows = rows.withColumn("kind", F.substring("value", 1, 1))
    at = lambda i: F.get("f", F.lit(i))
    known = number if strict else (lambda c: c)

    # Headers: a later line replaces an earlier one.
    listed = rows.filter("kind = 'H'").select("locus_id", "line_pos", _tag(F.col("f"), "RS:Z:").alias("rs")).filter("rs is not null")
    headers = listed.groupBy("locus_id").agg(F.max_by("rs", "line_pos").alias("rs")).select("locus_id", F.filter(F.split(F.substr("rs", F.lit(6)), " "), lambda x: x != "").alias("reference_samples"))

    s = rows.filter("kind = 'S'")
    raw = F.coalesce(at(2), F.lit(""))
    tags = _rest(F.col("f"), 4)
    if strict:
        seq, length = raw, F.length(raw).cast("long")
        s = s.filter(known(at(1)).isNotNull() & at(2).isNotNull())
    else:
        has = ~raw.isin("", "*")
        seq = F.when(has, raw).otherwise("")
        length = F.when(has, F.length(raw)).otherwise(F.coalesce(int_tag(tags, "LN"), F.lit(0))).cast("long")
    dp, reads = float_tag(tags, "dp"), F.coalesce(int_tag(tags, "KC"), int_tag(tags, "RC")).cast("double")
    segments = s.select(
        "locus_id", F.col("line_pos").alias("seg_pos"), (known(at(1)).cast("string") if strict else at(1)).alias("id"), seq.alias("seq"), length.alias("length"),
        int_tag(tags, "WC").alias("wc"), int_tag(tags, "WS").alias("ws"), int_tag(tags, "WE").alias("we"), F.split(string_tag(tags, "MB"), ",").alias("members"),
        F.coalesce(dp, reads).alias("depth"), F.when(dp.isNotNull(), "x").when(reads.isNotNull(), "reads").alias("depth_unit"),
        string_tag(tags, "SN").alias("sn"), int_tag(tags, "SO").alias("so"), int_tag(tags, "SR").cast("int").alias("sr"),
    )
    # A repeated id: the first line counts in the strict reading; in the viewer's, the last line at the first place.
    whole = Window.partitionBy("locus_id", "id")
    segments = segments.withColumn("first", F.min("seg_pos").over(whole)).withColumn("last", F.max("seg_pos").over(whole))
    segments = segments.filter(F.col("seg_pos") == F.col("first" if strict else "last")).withColumn("seg_pos", F.col("first")).drop("first", "last")

    l = rows.filter("kind = 'L'")  # noqa: E741
    if strict:
        l = l.filter(known(at(1)).isNotNull() & known(at(3)).isNotNull() & at(2).isNotNull() & at(4).isNotNull())  # noqa: E741
    links = l.select("locus_id", F.col("line_pos").alias("link_pos"), known(at(1)).cast("string").alias("from_id"), F.coalesce(at(2) == "-", F.lit(False)).alias("from_rev"), known(at(3)).cast("string").alias("to_id"), F.coalesce(at(4) == "-", F.lit(False)).alias("to_rev"), int_tag(_rest(F.col("f"), 6), "WC").alias("wc"))

    colon = F.transform(_rest(F.col("f"), 8), lambda t: F.split(t, ":"))
    pairs = F.transform(F.filter(colon, lambda p: F.size(p) >= 3), lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.array_join(F.slice(p, 3, 1 << 20), ":").alias("value")))
    # The last tag of a name counts.
    tag_map = F.map_from_entries(F.filter(F.transform(pairs, lambda p, i: F.when(~F.exists(F.slice(pairs, i + 2, F.lit(1 << 20)), lambda q: q["key"] == p["key"]), p)), lambda p: p.isNotNull()))
    as_number = number if strict else (lambda c: c.try_cast("double").cast("long"))
    w = rows.filter("kind = 'W'").select(
        "locus_id", F.col("line_pos").alias("walk_pos"), F.lit("W").alias("kind"), at(1).alias("sample"), at(2).try_cast("int").alias("hap"), at(3).alias("seq_id"),
        as_number(at(4)).alias("start"), as_number(at(5)).alias("end"), walk_weight(F.col("f")).alias("weight"), tag_map.alias("tags"), walk_steps(F.coalesce(at(6), F.lit(""))).alias("s"),
    )
    if strict:
        w = w.withColumn("s", F.transform(F.filter("s", lambda x: x["id"].rlike("^[0-9]+$")), lambda x: F.struct(number(x["id"]).cast("string").alias("id"), x["rev"].alias("rev"))))
    else:
        name = F.coalesce(at(1), F.lit(""))
        zero = F.lit(0).cast("long")
        p = rows.filter("kind = 'P'").select("locus_id", F.col("line_pos").alias("walk_pos"), F.lit("P").alias("kind"), name.alias("sample"), F.lit(0).alias("hap"), name.alias("seq_id"), zero.alias("start"), zero.alias("end"), F.lit(1).cast("long").alias("weight"), F.create_map().cast("map<string,string>").alias("tags"), path_steps(F.coalesce(at(2), F.lit(""))).alias("s"))
        w = w.unionByName(p)
    steps = w.select("locus_id", "walk_pos", F.posexplode("s").alias("step_pos", "x")).select("locus_id", "walk_pos", F.col("step_pos").cast("long").alias("step_pos"), "x.id", "x.rev")
    walks = w.drop("s")
    if not strict:
        # A path has no coordinates: it ends at the sum of the lengths it visits.
        spans = steps.join(walks.filter("kind = 'P'").select("locus_id", "walk_pos"), ["locus_id", "walk_pos"], "left_semi").join(segments.select("locus_id", "id", "length"), ["locus_id", "id"], "left").groupBy("locus_id", "walk_pos").agg(F.sum(F.coalesce("length", F.lit(0))).alias("span"))
        walks = walks.join(spans, ["locus_id", "walk_pos"], "left").withColumn("end", F.when(F.col("kind") == "P", F.coalesce("span", F.lit(0))).otherwise(F.col("end"))).drop("span")
    x = rows.filter("kind = 'X'")
    stats = x.groupBy("locus_id").agg(F.max_by("f", "line_pos").alias("f")).select("locus_id", *[F.coalesce(int_tag(F.col("f"), t), F.lit(0).cast("long")).alias(t) for t in STAT_TAGS])
    return Graph(segments, links, walks, steps, headers, stats)


def flip_orientation(lines: DataFrame) -> DataFrame:
    """The same graph with every segment stored on its other strand: sequences complemented, link signs and walk
    directions swapped."""
    from walkloom.functions.sequence import flipped_walk, revcomp

    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    tail = lambda i: F.slice(f, i, 1 << 20)
    sign = lambda c: F.translate(c, "+-", "-+")
    join = lambda *parts: F.array_join(F.concat(*[p if isinstance(p, Column) and k else F.array(p) for k, p in parts]), "\t")
    value = (
        F.when(at(0) == "S", join((0, at(0)), (0, at(1)), (0, revcomp(at(2))), (1, tail(4))))
        .when(at(0) == "L", join((0, at(0)), (0, at(1)), (0, sign(at(2))), (0, at(3)), (0, sign(at(4))), (1, tail(6))))
        .when(at(0) == "W", join((1, F.slice(f, 1, 6)), (0, flipped_walk(at(6))), (1, tail(8))))
        .otherwise(F.col("value"))
    )
    return lines.withColumn("value", value)


# --- sinks --------------------------------------------------------------------------------------------------------


def write_lines(lines: DataFrame, path: str) -> None:
    """One file per locus folder, lines in order (the un-reduced sink takes the lines as they came)."""
    ordered = lines.repartitionByRange("locus_id", "line_pos").sortWithinPartitions("locus_id", "line_pos")
    ordered.select("locus_id", "value").write.partitionBy("locus_id").text(path)


def first_lines(lines: DataFrame, most: int = 400) -> DataFrame:
    """The preview of a locus's text."""
    n = F.row_number().over(Window.partitionBy("locus_id").orderBy("line_pos"))
    return lines.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def size_guard(lines: DataFrame, most_bytes: int = 13 << 20) -> DataFrame:
    """(locus_id, bytes, refused): texts larger than a client should take."""
    return lines.groupBy("locus_id").agg(F.sum(F.octet_length("value") + 1).alias("bytes")).withColumn("refused", F.col("bytes") > most_bytes)
