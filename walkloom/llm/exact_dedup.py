"""Exact dedup with skew-safe combining.

Copies are combined three times, each time with whole contents compared (the content is a grouping key, the
digest only places it): inside each input task (map-side aggregation), among the tasks of one salt, and among
the salt winners of a digest. A group that holds a third of all rows thus reaches any reducer as one row per
task of its salt, then as one row per salt. Should two contents ever have one digest, the rows of that digest meet
their winners by content too.

Defined cases: null text counts as empty; empty texts are copies of each other; a null id loses every tie but is
kept if no other row has its text; of rows that agree in all that decides (id, size, content), exactly one is kept;
a text of any length is one grouping key, so a task holds at least the longest; an empty table gives an empty result;
other columns of the input, whatever their names, are untouched by `drop_copies` and not read by `exact_groups`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkloom.sharedfs import materialize

#: The characters of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def squeezed(text: Column) -> Column:
    """Text without the characters of [\\x20\\x09-\\x0D]; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def _size(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def group_winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(digest, body, keep_id, keep_cp, group_size): one row per distinct squeezed text. The longest original wins,
    then the smallest id, nulls last."""
    ident = F.col(id_col)
    win = F.struct(_size(F.col(text_col)).alias("cp"), ident.isNotNull().alias("known"), F.bitwise_not(ident).alias("inv"))
    rows = docs.select(squeezed(F.col(text_col)).alias("body"), win.alias("win"))
    rows = rows.select(digest(F.col("body")).alias("digest"), (F.spark_partition_id() % salts).alias("salt"), "body", "win")
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("win").alias("win"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "body").agg(F.max("win").alias("win"), F.sum("n").alias("n"))
    return whole.select("digest", "body", F.when(F.col("win.known"), F.bitwise_not(F.col("win.inv"))).alias("keep_id"), F.col("win.cp").alias("keep_cp"), F.col("n").alias("group_size"))


def _heads(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """(winners without their content, winners with it of the digests that several contents share, if any)."""
    won = group_winners(docs, id_col, text_col, salts, digest)
    head = materialize(won.drop("body"), "exact-groups")
    shared = head.groupBy("digest").count().filter("count > 1").select("digest")
    if not shared.limit(1).count():
        return head, None
    return head.join(shared, "digest", "left_anti"), materialize(won.join(shared, "digest", "left_semi"), "exact-shared")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, heavy_share: float = 0.001, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256, original_chars).

    Members find their group by digest, those of a shared digest by digest and content. Groups of at least
    `heavy_share` of all rows, of which there can be no more than 1 / heavy_share, are looked up in a broadcast table,
    so no join key holds more than that share.
    """
    head, shared = _heads(docs, id_col, text_col, salts, digest)
    names = ["keep_id", "keep_cp", "group_size"]
    body = squeezed(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), _size(F.col(text_col)).alias("cp"), digest(body).alias("digest"), F.monotonically_increasing_id().alias("row"), body.alias("body"))
    total = head.agg(F.sum("group_size")).first()[0] or 0
    out = rows.drop("body")
    if total * heavy_share >= 2:
        heavy = head.filter(F.col("group_size") >= max(2, int(total * heavy_share))).select(F.col("digest").alias("h_digest"), *[F.col(c).alias(f"h_{c}") for c in names])
        out = out.join(F.broadcast(heavy), F.col("digest") == F.col("h_digest"), "left")
        # Members of heavy groups find nothing more: their keys are no digests.
        look = F.when(F.col("h_digest").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")))
        out = out.withColumn("look", look).join(head.withColumnRenamed("digest", "look"), "look", "left")
        out = out.select("id", "cp", "digest", "row", *[F.when(F.col("h_digest").isNotNull(), F.col(f"h_{c}")).otherwise(F.col(c)).alias(c) for c in names])
    else:
        out = out.join(head, "digest", "left").select("id", "cp", "digest", "row", *names)
    if shared is not None:
        met = rows.join(shared, ["digest", "body"]).select("id", "cp", "digest", "row", *names)
        out = out.join(shared.select("digest").distinct(), "digest", "left_anti").unionByName(met)
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("cp") == F.col("keep_cp"))
    out = materialize(out.withColumn("kept", kept), "exact-rows")
    # Rows that agree in id, size and group: the first of them stays.
    again = out.filter("kept").groupBy("digest", "id", "cp", "group_size").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1")
    if again.limit(1).count():
        again = materialize(again, "exact-again")
        first = again.select(F.col("first").alias("row"), F.lit(True).alias("is_first"))
        tied = again.select(F.col("digest").alias("t_digest"), F.col("id").alias("t_id"), F.col("cp").alias("t_cp"), F.col("group_size").alias("t_n"))
        one = out.filter("kept").join(tied, (F.col("digest") == F.col("t_digest")) & F.col("id").eqNullSafe(F.col("t_id")) & (F.col("cp") == F.col("t_cp")) & (F.col("group_size") == F.col("t_n")), "left_semi")
        lost = one.select("row").join(first, "row", "left_anti").withColumn("lost", F.lit(True))
        out = out.join(lost, "row", "left").withColumn("kept", F.col("kept") & F.col("lost").isNull())
    return out.select("id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"), F.col("cp").alias("original_chars"))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs with one whole row per distinct squeezed text; all columns as they came. Rows that share the winning
    id and text but differ elsewhere are settled by the largest hash of the whole row (maps are hashed as JSON)."""
    head, shared = _heads(docs, id_col, text_col, salts, digest)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keyed = docs.select(row.alias("_row"), digest(squeezed(F.col(text_col))).alias("_digest"), _size(F.col(text_col)).alias("_cp"), name(F.col(id_col)).alias("_id"))
    keys = ["_digest", "_cp", "_id"]
    whole = F.to_json(F.struct("_row")) if _has_map(docs.schema) else F.col("_row")

    def stay(rows: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
        won = of.select(F.col("digest").alias("_digest"), F.col("keep_cp").alias("_cp"), name(F.col("keep_id")).alias("_id"), *([F.col("body").alias("_body")] if "_body" in keys else []))
        # Few rows agree in all keys; the window is dealt and sorted as the join is.
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(whole).desc()))
        return rows.join(won, keys, "left_semi").withColumn("_place", place).filter("_place = 1").select("_row.*")

    out = stay(keyed, head, keys)
    if shared is not None:
        out = out.unionByName(stay(keyed.withColumn("_body", squeezed(F.col(f"_row.{text_col}"))), shared, [*keys, "_body"]))
    return out
