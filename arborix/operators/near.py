"""Similarity of the pairs that are near at all, by an inverted index from cells to skeletons.

A table of scores has bins of distance, and what lies beyond the last edge scores
the last row. If that row holds one value, a pair without two points nearer than
the edge scores exactly this value: only pairs that share a cell, as wide as the
edge, or touch with one, need the kernel. The index joins the different cells of
the two sides, not their points; of what it finds each pair is computed once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import read_back
from .joins import around, cells
from .kernels import pair_score

CELL = ["c0", "c1", "c2"]
POINT = ["x", "y", "z", "tx", "ty", "tz"]


def near_pairs(queries: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(query, target) with a cell in common or side by side: all pairs with points within the radius, and some more."""
    placed = lambda df, name: df.select(F.col("skel_id").alias(name), *[c.alias(n) for c, n in zip(cells(radius), CELL, strict=True)]).distinct()
    beside = placed(targets, "target").withColumn("d", F.explode(around()))
    beside = beside.select("target", *[(F.col(c) + F.col(f"d.d{k}")).alias(c) for k, c in enumerate(CELL)]).distinct()
    return placed(queries, "query").join(beside, CELL).select("query", "target").distinct()


def far_score(table: np.ndarray) -> float:
    """What any two points beyond the last edge score."""
    if not (table[-1] == table[-1, 0]).all():
        raise ValueError("the table's last row must hold one value: pairs that are not near have no score of their own else")
    return float(table[-1, 0])


def blocks_of(points: DataFrame, name: str, radius: float, block: int) -> DataFrame:
    """(name, name_block): skeletons dealt to blocks of about ``block`` points, neighbours together."""
    number = max(1, -(-points.count() // block))
    coarse = [F.floor(F.avg(c) / F.lit(8.0 * radius)).alias(f"m{k}") for k, c in enumerate("xyz")]
    centers = points.groupBy(F.col("skel_id").alias(name)).agg(*coarse)
    dealt = centers.repartitionByRange(number, "m0", "m1", "m2", name).select(name, F.spark_partition_id().alias(f"{name}_block"))
    return read_back(dealt, "blocks")  # once: ranges are sampled


def similarity_of_near(queries: DataFrame, targets: DataFrame, table: np.ndarray, distances: np.ndarray, angles: np.ndarray, *, block: int = 200_000, ids: str = "long", fill: bool = True) -> DataFrame:
    """(query, target, score) as ``kernels.similarity`` has it, with the kernel run on near pairs only.

    ``fill``: also the other pairs, with the last row's value. A search that keeps scores above a threshold does without
    them. Skeletons are dealt to blocks by place, so that most pairs of blocks have no pair in common and are no group at all.
    """
    default, radius = far_score(table), float(distances[-1])
    pairs = near_pairs(queries, targets, radius)
    placed = pairs.join(blocks_of(queries, "query", radius, block), "query").join(blocks_of(targets, "target", radius, block), "target")
    placed = read_back(placed, "near")
    packed = lambda df, name, values: df.groupBy(F.col("skel_id").alias(name)).agg(F.flatten(F.sort_array(F.collect_list(F.array(*POINT)))).alias(values))
    wanted = placed.groupBy("query", "query_block", "target_block").agg(F.collect_list("target").alias("wanted"))  # at most a block's skeletons
    left = wanted.join(packed(queries, "query", "points"), "query")
    theirs = placed.select("target", F.col("query_block").alias("qb"), F.col("target_block").alias("tb")).distinct().join(packed(targets, "target", "t_points"), "target")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        held = {t: np.asarray(p, float).reshape(-1, 6) for t, p in zip(b["target"], b["t_points"], strict=True)}
        rows = []
        for query, points, some in zip(a["query"], a["points"], a["wanted"], strict=True):
            q = np.asarray(points, float).reshape(-1, 6)
            rows += [(query, t, pair_score(q, held[t], table, distances, angles)) for t in some]
        return pd.DataFrame(rows, columns=["query", "target", "score"])

    computed = left.groupBy("query_block", "target_block").cogroup(theirs.groupBy("qb", "tb")).applyInPandas(run, f"query {ids}, target {ids}, score double")
    if not fill:
        return computed
    computed = read_back(computed, "scores")
    every = queries.select(F.col("skel_id").alias("query")).distinct().crossJoin(targets.select(F.col("skel_id").alias("target")).distinct())  # what is asked for is a row for each pair
    return computed.unionByName(every.join(computed, ["query", "target"], "left_anti").withColumn("score", F.lit(default)))
