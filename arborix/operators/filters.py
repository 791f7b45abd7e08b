"""Filters, in the order in which the matching plan chains them: cheap ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named boxes (least x, y, z and most x, y, z); any other name takes the box of the given nodes.
BOXES = {
    "hemibrain": (302.6390, 1.6348, 18.2223, 870.4659, 529.5118, 442.0632),
    "hemibrain_flipped": (556.5341, 1.6348, 18.2223, 1124.3610, 529.5118, 442.0632),
}


def inside_box(box: tuple[float, ...]) -> Column:
    """Strictly inside on every axis."""
    condition = F.lit(True)
    for k, c in enumerate("xyz"):
        condition &= (F.col(c) > F.lit(float(box[k]))) & (F.col(c) < F.lit(float(box[k + 3])))
    return condition


def crop(nodes: DataFrame, box: str, of: DataFrame) -> DataFrame:
    """Nodes inside a named box, or inside the box of another set of nodes (one row, so the join is a filter)."""
    if box in BOXES:
        return nodes.filter(inside_box(BOXES[box]))
    limits = of.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xyz"])
    within = F.lit(True)
    for c in "xyz":
        within &= (F.col(c) > F.col(f"min_{c}")) & (F.col(c) < F.col(f"max_{c}"))
    return nodes.join(F.broadcast(limits), within).select(*nodes.columns)


def large_groups(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with more than ``least`` rows."""
    large = rows.groupBy(*keys).count().filter(F.col("count") > least).select(*keys)
    return rows.join(large, keys, "left_semi")


def either_score(threshold: float, *scores: str) -> Column:
    condition = F.lit(False)
    for s in scores:
        condition |= F.col(s) > F.lit(float(threshold))
    return condition


def best_score(threshold: float, *scores: str) -> Column:
    return F.greatest(*scores) > F.lit(float(threshold))


def adaptive_score(offset: float, factor: float, score: Column, frag_points: Column) -> Column:
    """Large fragments may score less; off when the factor is 0."""
    return score > F.lit(float(offset)) - frag_points / F.lit(float(factor)) if factor > 0 else F.lit(True)


def kept_groups(rows: DataFrame, keys: list[str], value: Column, most: float) -> DataFrame:
    """Rows of groups whose negated sum of values is at most the threshold: others cannot reach it."""
    reach = rows.groupBy(*keys).agg((-F.sum(value)).alias("__bound")).filter(F.col("__bound") <= F.lit(float(most))).select(*keys)
    return rows.join(reach, keys, "left_semi")


def covered_groups(covered: DataFrame, keys: list[str], point: str, weight: str, total: DataFrame, least: float) -> DataFrame:
    """Groups whose points, each counted once, reach ``least`` percent; with their coverage. total: points by em."""
    once = covered.select(*keys, point, weight).distinct()
    share = once.groupBy(*keys).agg(F.sum(weight).alias("__sum")).join(total, keys[0])
    return share.withColumn("aggregate", F.lit(100.0) * F.col("__sum") / F.col("points")).filter(F.col("aggregate") >= F.lit(float(least))).select(*keys, "aggregate")


def skip_worse_side(bounds: DataFrame) -> DataFrame:
    """Sides (em, lm_vol, side, lower, upper) whose lower bound does not exceed the other side's upper bound; a missing side skips nothing."""
    other = bounds.select("em_id", "lm_vol", F.when(F.col("side") == "normal", "flipped").otherwise("normal").alias("side"), F.col("upper").alias("other_upper"))
    return bounds.join(other, ["em_id", "lm_vol", "side"], "left").filter(F.col("other_upper").isNull() | (F.col("lower") <= F.col("other_upper")))


def before_first_empty(ranked: DataFrame, group: str, order: str, size: Column) -> DataFrame:
    """Rows of each group before its first row without entries: one aggregate, no window."""
    stop = ranked.filter(size == 0).groupBy(group).agg(F.min(order).alias("__stop"))
    return ranked.join(stop, group, "left").filter(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")
