"""Scalar functions on bases, orientations, keys and genomic coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    """Reverse complement; case kept, U as T, other symbols kept."""
    return F.reverse(F.translate(seq, "ACGTacgtUu", "TGCAtgcaAA"))


def oriented(seq: Column, rev: Column) -> Column:
    up = F.upper(seq)
    return F.when(rev, revcomp(up)).otherwise(up)


def edge_key(a: Column, b: Column) -> Column:
    """Unordered key of two ids."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def chain_step(from_id: Column, from_rev: Column, to_id: Column, to_rev: Column) -> Column:
    """The co-oriented step x -> y that a link stands for, read forward; null for loops and mixed orientations."""
    same = (from_rev == to_rev) & (from_id != to_id)
    return F.when(same & ~from_rev, F.struct(from_id.alias("x"), to_id.alias("y"))).when(same & from_rev, F.struct(to_id.alias("x"), from_id.alias("y")))


def trace_key(ids: Column) -> Column:
    """One key for a trace and its reverse."""
    return F.least(F.array_join(ids, ">"), F.array_join(F.reverse(ids), ">"))


def cell_signature(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.when(c.isNull(), ".").when(c == "", "?").otherwise(c)), "|")


def unversioned(accession: Column) -> Column:
    return F.substring_index(accession, ".", 1)


def log_ratio(value: Column, most: Column) -> Column:
    return F.when((value > 0) & (most > 0), F.log1p(value) / F.log1p(most)).otherwise(F.lit(0.0))


def js_round(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def gene_window(start: Column, end: Column, least: int = 20_000) -> tuple[Column, Column]:
    """The gene's span padded on both sides to at least `least` bases; never below 0."""
    pad = F.when(end - start < least, js_round((F.lit(least) - (end - start)) / 2)).otherwise(F.lit(0))
    return F.greatest(F.lit(0), start - pad).cast("long"), (end + pad).cast("long")


def event_size(length: Column, skipped: Column) -> Column:
    return F.greatest(length, skipped)


def event_class(length: Column, skipped: Column) -> Column:
    net = length - skipped
    return F.when(net == 0, "substitution").when(net < 0, "contraction").when(skipped == 0, "insertion").otherwise("expansion")


#: Display label and one-letter code of each class of event.
CLASS_LABELS = {"insertion": "insertion (0 bp ref)", "expansion": "net insertion", "contraction": "net deletion", "substitution": "substitution"}
CLASS_CODES = {"insertion": "ins", "expansion": "ins*", "contraction": "del", "substitution": "sub"}


def mapped(value: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.element_at(F.create_map(*pairs), value)


def walk_steps(walk: Column) -> Column:
    """`>1<2>u3` as an array of (id, rev)."""
    return F.transform(F.regexp_extract_all(walk, F.lit(r"[<>][^<>\s]+"), F.lit(0)), lambda s: F.struct(F.substr(s, F.lit(2)).alias("id"), s.startswith("<").alias("rev")))


def path_steps(path: Column) -> Column:
    """`1+,3-` as an array of (id, rev); tokens without an orientation are skipped."""
    ok = F.filter(F.split(path, ","), lambda t: (F.length(t) >= 2) & F.right(t, F.lit(1)).isin("+", "-"))
    steps = F.transform(ok, lambda t: F.struct(F.left(t, F.length(t) - 1).alias("id"), t.endswith("-").alias("rev")))
    return F.when(path == "*", F.array().cast("array<struct<id:string,rev:boolean>>")).otherwise(steps)


def flipped_walk(walk: Column) -> Column:
    return F.translate(walk, "<>", "><")


# --- display formats ----------------------------------------------------------------------------------------------


def format_bp(bp: Column) -> Column:
    return F.when(bp >= 1_000_000, F.concat(F.format_number(bp / 1_000_000, 2), F.lit(" Mb"))).when(bp >= 1_000, F.concat(F.format_number(bp / 1_000, 1), F.lit(" kb"))).otherwise(F.concat(bp.cast("string"), F.lit(" bp")))


def format_bytes(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.concat(F.format_number(n / (1 << 20), 2), F.lit(" MiB"))).when(n >= 1024, F.concat(F.format_number(n / 1024, 1), F.lit(" KiB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_percent(share: Column) -> Column:
    return F.concat(F.format_number(share * 100, 1), F.lit("%"))


def preview(items: Column, most: int) -> Column:
    """The first items joined, with how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


# --- colours and jitter -------------------------------------------------------------------------------------------


def hash31(text: Column) -> Column:
    """The 31-multiplier string hash, modulo 2^32."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))


def golden_hue(index: Column) -> Column:
    """Hues a golden angle apart, in degrees."""
    return F.pmod(index * F.lit(137.508), F.lit(360.0))


def heat_colour(ratio: Column, stops: tuple[tuple[int, int, int], ...] = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))) -> Column:
    """`rgb(r, g, b)` between evenly spaced stops; ratio is held between 0 and 1."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)) * (len(stops) - 1)
    i = F.least(F.lit(len(stops) - 2), F.floor(t)).cast("int")
    table = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in stops])
    low, high = F.element_at(table, i + 1), F.element_at(table, i + 2)
    parts = [js_round(F.element_at(low, k) + (F.element_at(high, k) - F.element_at(low, k)) * (t - i)).cast("string") for k in (1, 2, 3)]
    return F.concat(F.lit("rgb("), F.concat_ws(", ", *parts), F.lit(")"))


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def _times32(a: Column, b: Column) -> Column:
    """a * b mod 2^32 in parts that fit 64 bits."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return F.pmod(a * low + F.shiftleft(F.pmod(a * high, F.lit(1 << 16)), 16), F.lit(1 << 32))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the characters' codes."""
    return F.aggregate(_codes(text), F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32)))


def mulberry32(seed: Column) -> Column:
    """The first number in [0, 1) that this generator gives for a seed."""
    m = F.lit(1 << 32)
    t = F.pmod(seed + F.lit(0x6D2B79F5), m)
    t = _times32(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1)))
    u = _times32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))
    t = F.pmod(t + u, m).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / float(1 << 32)


def stable_unit(text: Column) -> Column:
    """A steady number in [-0.5, 0.5) for a text."""
    return mulberry32(fnv1a(text)) - 0.5


def coverage_rgb(cov: Column, total: Column) -> Column:
    """Yellow for one walk to red for all of them."""
    t = F.when(total <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cov - 1) / F.greatest(total - 1, F.lit(1)))))
    parts = [js_round(F.lit(float(a)) + F.lit(float(b - a)) * t).cast("string") for a, b in ((255, 214), (214, 30), (10, 30))]
    return F.concat(F.lit("rgb("), F.concat_ws(",", *parts), F.lit(")"))


def register(spark: SparkSession) -> None:
    """SQL names for the domain functions."""
    spark.sql("create or replace temporary function revcomp(s string) returns string return reverse(translate(s, 'ACGTacgtUu', 'TGCAtgcaAA'))")
    spark.sql("create or replace temporary function walk_steps(w string) returns array<struct<id string, rev boolean>> return transform(regexp_extract_all(w, '[<>][^<> ]+', 0), s -> struct(substr(s, 2) as id, startswith(s, '<') as rev))")
    spark.sql("create or replace temporary function unversioned(s string) returns string return substring_index(s, '.', 1)")
