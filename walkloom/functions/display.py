"""What views show of values: short texts, labels, and colours by metric and theme, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from walkloom.functions.sequence import js_round, log_ratio

# --- texts --------------------------------------------------------------------------------------------------------


def grouped(n: Column) -> Column:
    """A whole number with its thousands apart."""
    return F.format_number(n.cast("decimal(38,0)"), 0)


def percent_text(share: Column) -> Column:
    return F.concat(js_round(share * 100).cast("string"), F.lit("%"))


def size_text(n: Column) -> Column:
    """Bytes in the largest fitting unit: KiB whole, MiB and GiB with one decimal."""
    in_unit = lambda power, digits, unit: F.format_string(f"%.{digits}f {unit}", (n / F.lit(1024**power)).cast("double"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, in_unit(1, 0, "KiB")).when(n < 1024**3, in_unit(2, 1, "MiB")).otherwise(in_unit(3, 1, "GiB"))


def depth_text(depth: Column, unit: Column) -> Column:
    """Depth as a factor with one decimal, or as a number of reads."""
    return F.when(unit == "x", F.format_string("%.1f×", depth.cast("double"))).otherwise(F.concat(grouped(js_round(depth)), F.lit(" reads")))


def coordinate_text(contig: Column, start: Column, end: Column) -> Column:
    return F.concat(contig, F.lit(":"), grouped(start), F.lit("–"), grouped(end))


def steps_preview(steps: Column, most: int = 6) -> Column:
    """The first steps of array<struct<id, rev>> as walk text."""
    head = F.array_join(F.transform(F.slice(steps, 1, most), lambda s: F.concat(F.when(s["rev"], "<").otherwise(">"), s["id"])), "")
    return F.concat(head, F.when(F.size(steps) > most, "…").otherwise(""))


def members_preview(members: Column, most: int = 3) -> Column:
    head = F.array_join(F.slice(members, 1, most), ",")
    return F.when(F.size(members) > most, F.concat(head, F.lit(" +"), (F.size(members) - most).cast("string"), F.lit(" more"))).otherwise(head)


def sequence_preview(seq: Column, most: int = 40) -> Column:
    return F.when(F.length(seq) > most, F.concat(F.left(seq, F.lit(most)), F.lit("…"))).otherwise(seq)


# --- labels of walks ----------------------------------------------------------------------------------------------


def reference_label(sample: Column, kind: Column) -> Column:
    return F.when(kind == "synthetic", "reference (computed backbone)").when(sample == "unknown", "reference").otherwise(sample)


def walk_label(sample: Column, hap: Column) -> Column:
    return F.when(sample == "unknown", "non-reference walk").otherwise(F.concat(sample, F.coalesce(F.concat(F.lit(" (hap "), hap.cast("string"), F.lit(")")), F.lit(""))))


def endpoint_label(sample: Column, hap: Column) -> Column:
    return F.when(sample == "unknown", F.concat(F.lit("hap "), hap.cast("string"))).otherwise(F.concat(sample, F.lit("#"), hap.cast("string")))


# --- colours ------------------------------------------------------------------------------------------------------

#: Stops of the sequential colour maps (as matplotlib and D3 publish them), the window of each map that a
#: theme uses, the ends of the coverage ramp, and the tone of the backbone.
VIRIDIS = ((68, 1, 84), (72, 40, 120), (62, 74, 137), (49, 104, 142), (38, 130, 142), (31, 158, 137), (53, 183, 121), (110, 206, 88), (181, 222, 43), (253, 231, 37))
PLASMA = ((13, 8, 135), (70, 3, 159), (114, 1, 168), (156, 23, 158), (189, 55, 134), (216, 87, 107), (237, 121, 83), (251, 159, 58), (253, 202, 38), (240, 249, 33))
WINDOWS = {"length": {"dark": (0.32, 1.0), "light": (0.0, 0.72)}, "bubbleSize": {"dark": (0.3, 1.0), "light": (0.0, 0.72)}}
COVERAGE_ENDS = {"dark": ((255, 214, 10), (214, 30, 30)), "light": ((214, 158, 0), (185, 28, 28))}
GOLDEN_ANGLE = 137.508


def _rgb(parts: list[Column]) -> Column:
    return F.concat(F.lit("rgb("), F.concat_ws(", ", *[p.cast("string") for p in parts]), F.lit(")"))


def _held(ratio: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))


def mode_colour(mode: str, ratio: Column, theme: str = "dark") -> Column:
    """`rgb(r, g, b)` of a metric's ratio: length and bubbleSize on their colour maps, all others on the theme's ramp."""
    if mode not in WINDOWS:
        low, high = COVERAGE_ENDS[theme]
        return _rgb([js_round(F.lit(float(a)) + (b - a) * _held(ratio)) for a, b in zip(low, high, strict=True)])
    stops = VIRIDIS if mode == "length" else PLASMA
    lo, hi = WINDOWS[mode][theme]
    x = (F.lit(lo) + _held(ratio) * (hi - lo)) * (len(stops) - 1)
    i = F.least(F.floor(x), F.lit(len(stops) - 2)).cast("int")
    channel = lambda k: F.array(*[F.lit(float(s[k])) for s in stops])
    between = lambda k: F.element_at(channel(k), i + 1) + (F.element_at(channel(k), i + 2) - F.element_at(channel(k), i + 1)) * (x - i)
    return _rgb([js_round(between(k)) for k in range(3)])


def legend_gradient(mode: str, theme: str = "dark", steps: int = 8) -> Column:
    """A CSS gradient that shows the scale of mode_colour."""
    return F.concat(F.lit("linear-gradient(90deg, "), F.concat_ws(", ", *[mode_colour(mode, F.lit(i / steps), theme) for i in range(steps + 1)]), F.lit(")"))


def hue_of_text(text: Column) -> Column:
    """A golden-angle hue from the 31-multiplier hash of a text in signed 32 bits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32)))
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.pmod(F.abs(signed) * F.lit(GOLDEN_ANGLE), F.lit(360.0))


def text_colour(text: Column, lightness: int = 50) -> Column:
    return F.concat(F.lit("hsl("), hue_of_text(text).cast("string"), F.lit(f", 65%, {lightness}%)"))


def nth_colour(index: Column, lightness: int = 55) -> Column:
    """A colour for the n-th item, far from those beside it."""
    return F.concat(F.lit("hsl("), F.pmod(index * F.lit(GOLDEN_ANGLE), F.lit(360.0)).cast("string"), F.lit(f", 68%, {lightness}%)"))


def base_colour(base: Column, theme: dict[str, str]) -> Column:
    """The colour of a base; theme has A, C, G, T and other. U is drawn as T."""
    up = F.upper(base)
    out = F.when(up == "U", theme["T"])
    for b in "ACGT":
        out = out.when(up == b, theme[b])
    return out.otherwise(theme["other"])


def node_ratio(mode: str, value: Column, most: Column) -> Column:
    """Where a node's metric lies between nothing and the largest: linear for coverage, by logarithm for sizes."""
    if mode in WINDOWS:
        return log_ratio(value, most)
    return F.when(most > 0, value / most).otherwise(F.lit(0.0))
