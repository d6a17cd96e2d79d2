"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are word counts. A source's budget is its target in words: whole passes over the source first, then a
subset of its documents whose sizes add up to what is left. The subset is found on the histogram of exact
document lengths: a proportional share of each length, larger lengths while they fit, and a bounded-knapsack
dynamic programme over the lengths for the last `dp_words` words. Which documents of a length are taken is
settled by a seeded hash, counted off bucket by bucket, so that no length's documents meet in one task.

Defined cases: null or empty text has size 0 and takes nothing; null sources form one source, ordered last; a
null id is hashed like any value; repeated rows each count; a text of any length is counted whole, in place; sources and
distinct lengths are assumed to fit one task each (targets: one row a source; a source's plan: one row a length, no more
than the square root of twice its words); an empty table gives an empty result; extra columns
are ignored. Rows that agree in id, source and size are interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.sharedfs import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """sizes(source, source_size) -> + (weight, target). Weights repeat over the sources in code point order, null
    last. The whole is shared by weight with a ceiling of max_repeats times a source's size: target =
    min(ceiling, level * weight), where the level is the one at which the targets add up to the whole. Its place
    among the ceilings in order of ceiling / weight is found with running sums; the table has one row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("ratio", F.col("source").isNull(), "source")
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
    return s.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _dp(lengths: np.ndarray, counts: np.ndarray, budget: int, slack: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as near to budget as can be (ties: the smaller sum).
    Sums up to budget + slack are bits of one integer per length; counts are split in powers of two."""
    limit = budget + slack
    mask = (1 << (limit + 1)) - 1
    items: list[tuple[int, int]] = []
    for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
        c, k = min(c, limit // n), 1
        while c > 0:
            items.append((n, min(k, c)))
            c, k = c - k, 2 * k
    reach = [1]
    for n, k in items:
        reach.append((reach[-1] | (reach[-1] << (n * k))) & mask)
        if reach[-1] >> budget & 1:
            break
    last = reach[-1]
    low = (last & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = last >> (budget + 1)
    high = budget + 1 + ((above & -above).bit_length() - 1) if above else None
    at = low if high is None or budget - low <= high - budget else high
    take: dict[int, int] = {}
    for i in range(len(reach) - 2, -1, -1):
        if reach[i] >> at & 1:
            continue
        n, k = items[i]
        take[n] = take.get(n, 0) + k
        at -= n * k
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = 1 << 16) -> np.ndarray:
    """Bounded subset sum: how many documents of each length (ascending, all > 0) to take for budget words in all."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    part = max(0, budget - dp_words // 2)
    take = np.array([int(c) * part // total for c in counts.tolist()], np.int64)
    left = budget - int((lengths * take).sum())
    for i in range(len(lengths) - 1, -1, -1):  # longest first, while more is left than the programme covers
        if left <= dp_words:
            break
        k = min(int(counts[i] - take[i]), max(0, left - dp_words // 2) // int(lengths[i]))
        take[i] += k
        left -= k * int(lengths[i])
    rest = counts - take
    for n, k in _dp(lengths[rest > 0], rest[rest > 0], left, min(dp_words, int(lengths.max()))).items():
        take[np.searchsorted(lengths, n)] += k
    return take


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, seed: int = 20, dp_words: int = 1 << 16, bucket_rows: int = 50_000) -> DataFrame:
    """(id, source, size, source_size, target, copies): how many times each document is taken."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = materialize(sized, "mix-sizes")
    sized = sized.withColumn("draw", F.xxhash64(F.lit(seed), F.col("id"), F.col("size")))
    hist = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialize(source_targets(per, weights, max_repeats), "mix-targets")
    rows = hist.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + rows // bucket_rows

    def fit(lengths: pa.Table) -> pa.Table:
        lengths = lengths.sort_by("size")
        words, n = lengths["size"].to_numpy(), lengths["n"].to_numpy()
        size, want = lengths["source_size"][0].as_py(), int(round(lengths["target"][0].as_py()))
        passes = min(max_repeats, want // size) if size else 0
        live = words > 0
        more = np.zeros(len(words), np.int64)
        if passes < max_repeats:
            more[live] = fit_budget(words[live], n[live], want - passes * size, dp_words)
        out = lengths.select(["source", "size", "source_size", "target"])
        return out.append_column("passes", pa.array(np.full(len(words), passes), pa.int64())).append_column("more", pa.array(more, pa.int64()))

    joined = hist.join(targets.select(F.col("source").alias("t_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    plan = joined.groupBy("source").applyInArrow(fit, "source string, size long, source_size long, target double, passes long, more long")
    plan = materialize(plan, "mix-plan")
    # Documents of one length, counted off over buckets of the seeded draw: a bucket is taken whole, in part or not.
    key = [F.col("source"), F.col("size")]
    dealt = sized.withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    per_bucket = dealt.groupBy("source", "size", "bucket").agg(F.count("*").alias("in_bucket"))
    p = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "passes", "more", "source_size", "target")
    per_bucket = per_bucket.join(p, key[0].eqNullSafe(F.col("p_source")) & (key[1] == F.col("p_size"))).drop("p_source", "p_size")
    so_far = F.sum("in_bucket").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("in_bucket")
    quota = F.greatest(F.lit(0), F.least(F.col("in_bucket"), F.col("more") - so_far))
    per_bucket = per_bucket.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "passes", "source_size", "target", quota.alias("quota"))
    on = dealt["source"].eqNullSafe(F.col("b_source")) & (dealt["size"] == F.col("b_size")) & (dealt["bucket"] == F.col("b_bucket"))
    placed = dealt.join(per_bucket, on).withColumn("place", F.row_number().over(Window.partitionBy("b_source", "b_size", "b_bucket").orderBy("draw", "id")))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + (F.col("place") <= F.col("quota")).cast("long"))
    return placed.select("id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs repeated as often as the mix takes them; documents without a word are dropped, as they add nothing."""
    names = docs.columns
    plan = mix(docs, id_col, text_col, source_col, **how).filter("copies > 0").groupBy(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.array_sort(F.collect_list("copies")).alias("_copies"))
    # Rows alike in id, source and size are told apart by their place only.
    place = F.row_number().over(Window.partitionBy("_d_id", "_d_source", "_d_size").orderBy(F.xxhash64("_row")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_d_id"), F.col(source_col).alias("_d_source"), word_count(F.col(text_col)).alias("_d_size"))
    on = F.col("_d_id").eqNullSafe(F.col("_id")) & F.col("_d_source").eqNullSafe(F.col("_source")) & (F.col("_d_size") == F.col("_size"))
    met = rows.join(plan, on).withColumn("_n", F.coalesce(F.get("_copies", place - 1), F.lit(0)))
    return met.filter("_n > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
