"""Walk aggregates as they arrive: structure and coverage are commutative, so a stream of steps folds into them.

The strand vote needs the reference first: the axis is a static table that the stream is joined to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from walkloom.functions.sequence import walk_steps
from walkloom.sources.gfa import walk_weight


def stream_walk_lines(spark: SparkSession, folder: str) -> DataFrame:
    """W lines of GFA files as they land in a folder: (locus_id, sample, weight, s)."""
    lines = spark.readStream.text(folder).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.gfa$", "").alias("locus_id"), F.split("value", "\t").alias("f")).filter(F.get("f", F.lit(0)) == "W")
    return lines.select("locus_id", F.get("f", F.lit(1)).alias("sample"), walk_weight(F.col("f")).alias("weight"), walk_steps(F.coalesce(F.get("f", F.lit(6)), F.lit(""))).alias("s"))


def streaming_node_coverage(walks: DataFrame) -> DataFrame:
    """Haplotypes per node: nodes are made distinct inside the walk's own row, so no state per walk is kept."""
    ids = F.array_distinct(F.transform("s", lambda x: x["id"]))
    return walks.select("locus_id", "weight", F.explode(ids).alias("id")).groupBy("locus_id", "id").agg(F.sum("weight").alias("wc"))


def streaming_edge_coverage(walks: DataFrame) -> DataFrame:
    """Haplotypes per unordered pair of neighbours."""
    pairs = F.transform(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), lambda x, i: F.struct(F.least(x["id"], F.get("s", i + 1)["id"]).alias("a"), F.greatest(x["id"], F.get("s", i + 1)["id"]).alias("b")))
    each = F.array_distinct(F.filter(pairs, lambda p: p["a"] != p["b"]))
    return walks.select("locus_id", "weight", F.explode(each).alias("e")).groupBy("locus_id", "e.a", "e.b").agg(F.sum("weight").alias("wc"))


def start_fold(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
