"""The corpus pipeline: quality filter, exact dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the docs
of the next one. All but the last return the columns of `documents`, whatever they are, and read `doc_id`, `text` and
`source` of them only.

Defined cases, for every stage: null text counts as empty; texts of any length are read whole; rows without an id, and
rows that repeat one, are documents like any others; ids must be numbers or read as such; an empty table gives an
empty result with the same columns; ties are settled by the smallest id, then by hashes of the row, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from walkloom.llm.exact_dedup import drop_copies
from walkloom.llm.mixing import take_mix
from walkloom.llm.near_dup import drop_near_copies
from walkloom.llm.packing import pack
from walkloom.llm.quality import keep_good
from walkloom.sharedfs import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts; it learns from `labels` of this corpus. Without both labels all
    stay; empty texts are scored like any others."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each squeezed text: the longest original, then the smallest id, one row where rows repeat.
    Empty texts, also null ones, are one group."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8 or more: that of the smallest id.
    Texts without words all stay."""
    return drop_near_copies(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix of sources takes them, at most three times; those without words add
    nothing and go. A null source is a source of its own, ordered last."""
    return take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 2048 tokens; a repeated document is packed as often as it comes."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: Learned scores, MinHash and a tokenizer are beyond SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
