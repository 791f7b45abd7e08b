"""Coverage, colour, label and intensity aggregates; all have partial forms, so a large group meets as few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def rescaled_weights(points: DataFrame, group: str, weight: str) -> DataFrame:
    """Weights of a group's points scaled so that their sum is their number."""
    total = points.groupBy(group).agg(F.sum(weight).alias("__sum"), F.count("*").alias("__n"))
    return points.join(total, group).withColumn(weight, F.col(weight) * F.col("__n") / F.col("__sum")).drop("__sum", "__n")


def fragment_coverage(covered: DataFrame, points: DataFrame, em: str, fragment: list[str], weight: str) -> DataFrame:
    """Percent of a target's weight that each fragment covers. points: number of points by em."""
    return covered.groupBy(em, *fragment).agg(F.sum(weight).alias("__w")).join(points, em).withColumn("coverage", F.lit(100.0) * F.col("__w") / F.col("points")).drop("__w", "points")


def aggregate_coverage(covered: DataFrame, points: DataFrame, em: str, group: list[str], point: str, weight: str) -> DataFrame:
    """Percent that a group's fragments cover together: each point counts once."""
    return fragment_coverage(covered.select(em, *group, point, weight).distinct(), points, em, group, weight)


def point_coverage(covered: DataFrame, points: DataFrame, em: str, group: list[str], point: str) -> DataFrame:
    """Extra: percent of points, unweighted."""
    return covered.groupBy(em, *group).agg(F.count_distinct(point).alias("n")).join(points, em).withColumn("coverage", F.lit(100.0) * F.col("n") / F.col("points")).drop("n", "points")


def adjusted_coverage(covered: DataFrame, points: DataFrame, em: str, group: list[str], fragment: str, point: str, weight: str, value: str) -> DataFrame:
    """Coverage when every point goes to the one fragment with the largest positive value (of equals the least id)."""
    best = covered.filter(F.col(value) > 0).groupBy(em, *group, point).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(fragment)).alias("f"), F.col(weight).alias("w"))).alias("b"))
    won = best.select(em, *group, (-F.col("b.f")).alias(fragment), F.col("b.w").alias(weight))
    return fragment_coverage(won, points, em, [*group, fragment], weight)


def nearest_coverage(covered: DataFrame, points: DataFrame, em: str, group: list[str], fragment: str, point: str, weight: str, limit: float) -> DataFrame:
    """Extra: every point goes to its nearest fragment, if nearer than the limit (squared)."""
    best = covered.filter(F.col("d2") < F.lit(float(limit))).groupBy(em, *group, point).agg(F.min(F.struct("d2", fragment, F.col(weight).alias("w"))).alias("b"))
    return fragment_coverage(best.select(em, *group, F.col(f"b.{fragment}"), F.col("b.w").alias(weight)), points, em, [*group, fragment], weight)


def shared_coverage(covered: DataFrame, points: DataFrame, em: str, group: list[str], fragment: str, point: str) -> DataFrame:
    """Extra: a point covered by k fragments is worth 1/k to each."""
    each = covered.select(em, *group, fragment, point).distinct()
    k = each.groupBy(em, *group, point).agg(F.count("*").alias("k"))
    worth = each.join(k, [em, *group, point]).withColumn("__w", F.lit(1.0) / F.col("k"))
    return fragment_coverage(worth, points, em, [*group, fragment], "__w")


def label_counts(voxels: DataFrame, group: list[str]) -> DataFrame:
    return voxels.groupBy(*group).agg(F.count("*").alias("voxels"))


def label_diagonals(voxels: DataFrame, group: list[str], label: str, threshold: float) -> DataFrame:
    """Diagonal of each label's box, in voxels; background counts as twice the threshold and so always stays."""
    extent = [(F.max(c) - F.min(c) + 1).cast("double").alias(f"__{c}") for c in "zyx"]
    box = voxels.groupBy(*group).agg(*extent)
    length = F.sqrt(sum((F.col(f"__{c}") * F.col(f"__{c}") for c in "zyx"), F.lit(0.0)))
    return box.select(*group, F.when(F.col(label) == 0, F.lit(2.0 * threshold)).otherwise(length).alias("diagonal"))


def color_mode(voxels: DataFrame, group: list[str], bin_size: int = 64) -> DataFrame:
    """The most frequent colour bin of each group; of equals the least."""
    bins = voxels.groupBy(*group, *[scalars.quantized(F.col(c), bin_size).alias(f"q{c}") for c in "rgb"]).agg(F.count("*").alias("n"))
    best = bins.groupBy(*group).agg(F.max(F.struct("n", (-F.col("qr")).alias("r"), (-F.col("qg")).alias("g"), (-F.col("qb")).alias("b"))).alias("m"))
    return best.select(*group, *[(-F.col(f"m.{c}")).alias(c) for c in "rgb"], F.col("m.n").alias("n"))


def bounds(unaries: DataFrame, adjusted: DataFrame, keys: list[str], unary: str, adjusted_unary: str) -> DataFrame:
    """Upper bound of the energy: the best single fragment; lower bound: all adjusted unaries and no pairwise cost."""
    upper = unaries.groupBy(*keys).agg((-F.max(unary)).alias("upper"))
    lower = adjusted.groupBy(*keys).agg((-F.sum(adjusted_unary)).alias("lower"))
    return upper.join(lower, keys)


def box(nodes: DataFrame, group: list[str]) -> DataFrame:
    return nodes.groupBy(*group).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


def projection(voxels: DataFrame, group: list[str], value: Column) -> DataFrame:
    """Largest value over depth at each (y, x), and the depth where it stands first."""
    best = voxels.groupBy(*group, "y", "x").agg(F.max(F.struct(value.alias("v"), (-F.col("z")).alias("z"))).alias("m"))
    return best.select(*group, "y", "x", F.col("m.v").alias("intensity"), (-F.col("m.z")).alias("depth"))


def clip_value(values: DataFrame, quantile: float, channels: list[str], *, positive: bool = False) -> DataFrame:
    """One row: the largest of the channels' exact quantiles (of positive values only, where asked)."""
    each = [F.percentile(F.when(F.col(c) > 0, F.col(c)) if positive else F.col(c), F.lit(quantile)) for c in channels]
    return values.agg(F.greatest(*[F.coalesce(e, F.lit(0.0)) for e in each]).alias("clip"))


def best_channel(colors: DataFrame, group: list[str]) -> DataFrame:
    """The channel (0, 1, 2) with the largest mean colour; of equals the first."""
    mean = colors.groupBy(*group).agg(*[F.avg(c).alias(f"__{c}") for c in "rgb"])
    r, g, b = (F.col(f"__{c}") for c in "rgb")
    return mean.select(*group, F.when((r >= g) & (r >= b), 0).when(g >= b, 1).otherwise(2).alias("channel"))


def cable_length(edges: DataFrame, group: str) -> DataFrame:
    from .joins import squared

    return edges.groupBy(group).agg(F.sum(F.sqrt(squared("l_", "r_"))).alias("length"))


def first_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("nth") <= n)
