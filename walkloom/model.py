"""The tables of a set of loci. Every table leads with locus_id; input order is kept in *_pos columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.sharedfs import materialize

STEP = "struct<id:string,rev:boolean>"
SEGMENTS = "locus_id string, seg_pos long, id string, seq string, length long, wc long, ws long, we long, members array<string>, depth double, depth_unit string, sn string, so long, sr int"
LINKS = "locus_id string, link_pos long, from_id string, from_rev boolean, to_id string, to_rev boolean, wc long"
WALKS = "locus_id string, walk_pos long, kind string, sample string, hap int, seq_id string, start long, end long, weight long, tags map<string,string>"
STEPS = "locus_id string, walk_pos long, step_pos long, id string, rev boolean"
#: The counters of a reduced graph's X record, in the order of the line.
STAT_TAGS = ("SB", "SA", "LB", "LA", "ST", "NR", "SN", "BR", "UM", "TW", "NW", "NS", "WR", "TS")


@dataclass(frozen=True)
class Graph:
    segments: DataFrame
    links: DataFrame
    walks: DataFrame
    steps: DataFrame
    headers: DataFrame | None = None  # locus_id, reference_samples array<string>
    stats: DataFrame | None = None  # locus_id and STAT_TAGS, only for reduced graphs

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)

    def stored(self) -> Graph:
        """The same tables, written once in the shared folder: later plans start from scans."""
        return self.with_(**{k: materialize(v, f"graph-{k}") for k, v in vars(self).items() if v is not None})


def pick_reference(g: Graph, sample: str | None = None) -> DataFrame:
    """(locus_id, walk_pos): the first walk of the sample, else the first walk."""
    is_ref = F.col("sample").eqNullSafe(F.lit(sample)) if sample is not None else F.lit(False)
    return g.walks.groupBy("locus_id").agg(F.min_by("walk_pos", F.struct((~is_ref).alias("o"), F.col("walk_pos").alias("p"))).alias("walk_pos"))


def pick_alignment_reference(g: Graph, sample: str) -> DataFrame:
    """First walk of the sample, else the first that is not synthetic, else the first."""
    order = F.struct((F.col("sample") != sample).alias("a"), (F.col("kind") == "synthetic").alias("b"), F.col("walk_pos").alias("p"))
    return g.walks.groupBy("locus_id").agg(F.min_by("walk_pos", order).alias("walk_pos"))
