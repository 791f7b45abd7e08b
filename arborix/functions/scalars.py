"""Scalar expressions over coordinates, scores, colours and names; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width of a mirrored volume, in voxels.
WIDTH = 1427


def scaled(*columns: str, factor: float = 1.0) -> dict[str, Column]:
    return {c: F.col(c) * F.lit(float(factor)) for c in columns}


def mirrored(x: Column, width: float = WIDTH) -> Column:
    return F.lit(float(width)) - x


def shifted_score(score: Column, *, most: float = 1.0, factor: float = 1.0, least: float = -1.0) -> Column:
    """Score clipped from above, scaled, and moved so that ``least`` becomes 0."""
    return F.least(score, F.lit(float(most))) * F.lit(float(factor)) - F.lit(float(least))


def shifted_threshold(threshold: float, *, factor: float = 1.0, least: float = -1.0) -> float:
    return threshold * factor - least


def upper_unary(score: Column, frag_points: Column, em_points: Column) -> Column:
    """No fragment covers more than its share of points, times 1.4, in percent."""
    return score * F.lit(100.0) * F.lit(1.4) * frag_points / em_points


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def damped_score(score: Column, coverage: Column) -> Column:
    """Scores of fragments that cover little move away from the fixed point 2."""
    return (sigmoid(-coverage / F.lit(5.0)) + F.lit(1.0)) * (score - F.lit(2.0)) + F.lit(2.0)


def unary(score: Column, coverage: Column) -> Column:
    return coverage * score


def bright_color(r: Column, g: Column, b: Column, position: Column) -> list[Column]:
    """Channels, told apart by a little of their position, scaled so that the largest is 255."""
    jitter = [c + F.lit(0.001) * position for c in (r, g, b)]
    return [c * F.lit(255.0) / F.greatest(*jitter) for c in jitter]


def color_cost(a: list[Column], b: list[Column], *, bin_size: float = 32.0, slack: float = 16.0) -> Column:
    """Cost of joining two fragments: small if the channels differ in one direction, else their spread."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    high, low = F.greatest(*d), F.least(*d)
    one_way = (low > F.lit(-slack)) | (high < F.lit(slack))
    return F.when(one_way, F.lit(0.1) * F.greatest(*(F.abs(x) for x in d)) / F.lit(bin_size)).otherwise((high - low) / F.lit(bin_size))


def rounded(c: Column, digits: int) -> Column:
    """A number of at least 0, rounded half up in floating point, as the SQL has it. ``F.round`` goes through decimal text."""
    scaled = c * F.lit(10.0**digits)
    whole = F.rint(scaled)  # half to even
    return (whole + F.when(scaled - whole == 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)


def overlap_cost(overlap: Column, score_a: Column, score_b: Column) -> Column:
    """Extra, not used by any plan: overlap times the lesser score, 0 if unknown."""
    return F.coalesce(overlap * F.least(score_a, score_b), F.lit(0.0))


def quantized(channel: Column, bin_size: int = 64) -> Column:
    return (F.floor((channel + F.lit(bin_size // 2)) / F.lit(bin_size)) * F.lit(bin_size)).cast("long")


def clipped_intensity(value: Column, clip: Column) -> Column:
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), clip) / clip * F.lit(255.0)).cast("int")


def hex_channels(color: Column) -> list[Column]:
    """R, G, B of "#rrggbb" or "rrggbb"."""
    plain = F.ltrim(color, F.lit("#"))
    return [F.conv(F.substring(plain, k, 2), 16, 10).cast("int") for k in (1, 3, 5)]


def volume_of(name: Column) -> Column:
    """"<volume>_<fragment>" -> volume: all before the last underscore."""
    return F.regexp_extract(name, r"^(.*)_[^_]*$", 1)


def fragment_of(name: Column) -> Column:
    return F.substring_index(name, "_", -1).cast("int")


def line_of(volume: Column) -> Column:
    return F.substring_index(volume, "-", 1)


def em_number(em: Column) -> Column:
    """The number that an EM name begins with, before "_" and "-"."""
    return F.substring_index(F.substring_index(em, "_", 1), "-", 1).cast("long")


def em_group(number: Column) -> Column:
    """Folder of a number: its last two digits."""
    return F.lpad((number % 100).cast("string"), 2, "0")


def report_name(file: Column) -> dict[str, Column]:
    """Parts of "<em>_cr_<rank>_..._..._<line parts>-<slide code>_...png": em, rank, line, slide code."""
    tail = F.split(F.split(F.substring_index(file, "/", -1), "_cr_")[1], "_")
    line = F.split(F.substring_index(F.array_join(F.slice(tail, 4, 4), "_"), "-", 1), "_")[1]
    slide = F.split(F.array_join(F.slice(tail, 7, 3), "_"), "-")[1]
    return {"em": F.split(F.substring_index(file, "/", -1), "_cr_")[0], "rank": tail[0].cast("int"), "line_name": F.concat(F.lit("R"), line), "slide_code": slide}


def palette_color(label: Column) -> list[Column]:
    """A colour for each label that is the same in every run; 0 stays black."""
    return [F.when(label == 0, F.lit(0)).otherwise((label * F.lit(m) % F.lit(p)) % F.lit(255) + F.lit(1)).cast("int") for m, p in ((7919, 10007), (104729, 20011), (1299709, 30011))]


def line_voxels(start: list[Column], end: list[Column]) -> Column:
    """Voxels (array of struct z, y, x) from start, excluded, to end in steps of the longest axis."""
    a, b = ([F.rint(c) for c in p] for p in (start, end))
    longest = F.greatest(*(F.abs(q - p) for p, q in zip(a, b, strict=True)))
    steps = F.when(longest >= 1, F.sequence(F.lit(1), longest.cast("int"))).otherwise(F.array().cast("array<int>"))
    at = lambda p, q, k: F.rint(p + (q - p) / longest * k).cast("int")
    return F.transform(steps, lambda k: F.struct(*[at(p, q, k).alias(n) for p, q, n in zip(a, b, "zyx", strict=True)]))


def report_scale(score: Column, coverage: Column) -> list[Column]:
    """Score in hundredths and coverage, both cut to whole numbers."""
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")
    return [whole(score * F.lit(100.0)), whole(coverage)]
