"""Ranks, merges of rankings, best-of rules, report order. Ties always go to a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: str, *order: Column, into: str = "rank") -> DataFrame:
    """0-based position within the group."""
    return rows.withColumn(into, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("int"))


def top(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n of each group; every task keeps n rows of a group before the shuffle."""
    return ranked(rows, group, *order).filter(F.col("rank") < n)


def merged_ranks(regular: DataFrame, pruned: DataFrame, em: str, volume: str, *, lead: int = 10) -> DataFrame:
    """Ranks of two runs as one: the pruned run's match replaces the regular one if it leads by more than ``lead``
    places, and then stands half a place behind its own. Volumes that only the pruned run has are dropped."""
    other = pruned.select(em, volume, F.col("rank").alias("__other"))
    takes = F.col("__other") + lead < F.col("rank")
    joined = regular.join(other, [em, volume], "left").withColumn("nblast_pruned", F.coalesce(takes, F.lit(False)))
    key = F.when(F.col("nblast_pruned"), F.col("__other") + F.lit(0.5)).otherwise(F.col("rank").cast("double"))
    placed = joined.withColumn("merged_rank", key).drop("__other")
    return ranked(placed, em, F.col("merged_rank"), F.col(volume), into="position")


def best_of(rows: DataFrame, keys: list[str], energy: str, tie: str) -> DataFrame:
    """The row of least energy of each key, if it is below 0; of equals the first by ``tie``."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.filter(F.col(energy) < 0).groupBy(*keys).agg(F.min(F.struct(energy, tie, *[c for c in rest if c not in (energy, tie)])).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def paged(rows: DataFrame, group: str, *order: Column, size: int) -> DataFrame:
    """Page of each row of a group, in order, ``size`` rows to a page."""
    return ranked(rows, group, *order, into="position").withColumn("page", F.floor(F.col("position") / size).cast("int"))


def by_line(rows: DataFrame, em: str, line: str, rank: str) -> DataFrame:
    """Bookmark order: lines by their best rank, and the ranks within a line."""
    first = rows.groupBy(em, line).agg(F.min(rank).alias("__first"))
    placed = rows.join(first, [em, line])
    return ranked(placed, em, F.col("__first"), F.col(line), F.col(rank), into="bookmark").drop("__first")


def with_defaults(volumes: DataFrame, results: DataFrame, keys: list[str], value: str, default: float = 0.0) -> DataFrame:
    """Every volume, with the default where it has no result."""
    return volumes.join(results, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))
