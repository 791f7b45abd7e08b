"""Skeleton graphs: degrees, components, paths. Built on edge tables; deep trees go by doubling, not by depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import work_folder


def degrees(nodes: DataFrame, group: str = "skel_id") -> DataFrame:
    """Neighbours of each node: its children and its parent."""
    ends = nodes.filter("parent_id <> -1").select(group, F.explode(F.array("node_id", "parent_id")).alias("node_id"))
    counted = ends.groupBy(group, "node_id").agg(F.count("*").alias("degree"))
    return nodes.select(group, "node_id").join(counted, [group, "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def roots_by_doubling(nodes: DataFrame, group: str = "skel_id") -> DataFrame:
    """(group, node_id, root, hops): every node's root and its distance in edges.

    Each round doubles how far a node sees along its parents, so a path of n
    nodes takes log2(n) rounds; each round's pointers are a table.
    """
    spark, k = nodes.sparkSession, 0
    state = nodes.select(group, "node_id", F.when(F.col("parent_id") == -1, F.col("node_id")).otherwise(F.col("parent_id")).alias("root"), F.when(F.col("parent_id") == -1, 0).otherwise(1).cast("long").alias("hops"))
    while True:
        ahead = state.select(group, F.col("node_id").alias("root"), F.col("root").alias("__far"), F.col("hops").alias("__more"))
        moved = state.join(ahead, [group, "root"]).select(group, "node_id", F.col("__far").alias("root"), (F.col("hops") + F.col("__more")).alias("hops"), (F.col("__far") != F.col("root")).alias("__moved"))
        path = work_folder(spark, f"roots{k}")
        moved.write.parquet(path)
        table = spark.read.schema(moved.schema).parquet(path)
        state, k = table.drop("__moved"), k + 1
        if table.filter("__moved").isEmpty():
            return state


def components(nodes: DataFrame, group: str = "skel_id") -> DataFrame:
    """(group, node_id, component): the least node_id of the node's component."""
    rooted = roots_by_doubling(nodes, group)
    least = rooted.groupBy(group, "root").agg(F.min("node_id").alias("component"))
    return rooted.join(least, [group, "root"]).select(group, "node_id", "component")


def spine(nodes: DataFrame, group: str = "skel_id") -> DataFrame:
    """(group, leaf, hops): the deepest node below a root, the end of the longest path from it; of equals the least."""
    deepest = roots_by_doubling(nodes, group).groupBy(group).agg(F.max(F.struct("hops", (-F.col("node_id")).alias("n"))).alias("m"))
    return deepest.select(group, (-F.col("m.n")).alias("leaf"), F.col("m.hops").alias("hops"))


def resampled(nodes: DataFrame, step: float, group: str = "skel_id") -> DataFrame:
    """(group, node_id, x, y, z): points along each edge at most ``step`` apart, from the parent (excluded) to the node; nodes without parent stay."""
    parents = nodes.select(group, F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in "xyz"])
    joined = nodes.select(group, "node_id", "parent_id", *"xyz").join(parents, [group, "parent_id"], "left")
    d = [F.col(c) - F.col(f"p_{c}") for c in "xyz"]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    steps = F.coalesce(F.greatest(F.lit(1), F.ceil(length / F.lit(float(step)) - F.lit(1e-9)).cast("int")), F.lit(1))
    placed = joined.withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return placed.select(group, "node_id", *[F.coalesce(F.col(f"p_{c}") + d[k] * (F.col("i") / F.col("n")), F.col(c)).alias(c) for k, c in enumerate("xyz")])
