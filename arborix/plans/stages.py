"""The search as stages that run one by one, each from folders to a folder: ``python -m arborix.plans.stages STAGE --help``.

Paths are relative to ``--data`` (by default the environment's ``ARBORIX_DATA``). A stage whose result is there already
is left alone unless ``--again`` is given; ``follow`` goes on where it stopped. Sides are told apart by name: the second holds the mirrored fragments.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable
from dataclasses import fields
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import filters as FI
from ..operators import kernels as K
from ..operators import near as N
from ..operators import paths as P
from ..operators import skeletonize as T
from ..sources import files, volumes
from . import progress, search

DOTPROPS = "skel string, node_id int, x double, y double, z double, tx double, ty double, tz double"
SIDES = ("normal", "flipped")


def small(spark: SparkSession, o: argparse.Namespace) -> None:
    """A label volume without the labels of few voxels."""
    voxels = volumes.load_labels(spark, o.labels, o.key)
    shape = [int(m) + 1 for m in voxels.agg(*[F.max(c) for c in "zyx"]).first()]
    volumes.write_zarr(FI.large_groups(voxels, ["label"], o.least_voxels), o.out, o.key, ["z", "y", "x"], "label", shape, [64, 64, 64])


def skeletons(spark: SparkSession, o: argparse.Namespace) -> None:
    """A file <volume>_<label>.swc for each label of a volume."""
    nodes = T.skeletonize(volumes.load_labels(spark, o.labels, o.key), ["label"], least_cable=o.least_cable)
    named = nodes.withColumns({"skel": F.concat(F.lit(f"{o.volume}_"), F.col("label").cast("string")), "node_type": F.lit(0), "diameter": F.col("radius")})
    files.write_swc(named, o.out)


def prune(spark: SparkSession, o: argparse.Namespace) -> None:
    """Skeletons without their short branches, numbered anew."""
    nodes = files.read_back(files.read_swc(spark, o.skeletons), "skeletons").withColumnRenamed("skel", "skel_id")
    left = K.per_skeleton(nodes, K.prune(o.length, o.rounds), "skel_id string, node_id int")
    kept = files.read_back(nodes.join(left, ["skel_id", "node_id"]), "pruned")
    new = K.per_skeleton(kept, K.relabel, "skel_id string, node_id int, new_id int, new_parent int")
    rows = new.join(kept.drop("parent_id"), ["skel_id", "node_id"]).drop("node_id")
    files.write_swc(rows.withColumnsRenamed({"skel_id": "skel", "new_id": "node_id", "new_parent": "parent_id"}), o.out)


def resample(spark: SparkSession, o: argparse.Namespace) -> None:
    """Skeletons with a node every ``--step`` along their segments, a file each."""
    new = P.resampled(files.read_back(files.read_swc(spark, o.skeletons), "skeletons"), o.step, "skel", ("x", "y", "z", "diameter"))
    files.write_swc(new.withColumn("node_type", F.lit(0)), o.out)


def spines(spark: SparkSession, o: argparse.Namespace) -> None:
    """The longest path of each skeleton, a file each."""
    files.write_swc(P.spine(files.read_back(files.read_swc(spark, o.skeletons), "skeletons"), "skel"), o.out)


def colors(spark: SparkSession, o: argparse.Namespace) -> None:
    """The commonest colour of each label of a volume."""
    voxels = volumes.load_labels(spark, o.labels, o.key).join(volumes.load_raw(spark, o.raw, o.raw_key), ["z", "y", "x"])
    A.color_mode(voxels, ["label"]).select(F.lit(o.volume).alias("lm_vol"), F.col("label").cast("int").alias("frag_id"), "r", "g", "b").write.mode("append").parquet(o.out)


def _dotprops(nodes: DataFrame, k: int) -> DataFrame:
    return K.per_skeleton(nodes.select("skel", "node_id", "x", "y", "z"), K.dotprops(k, "skel"), DOTPROPS, "skel").withColumnRenamed("skel", "skel_id")


def _sides(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    normal = files.read_swc(spark, o.fragments)
    flipped = normal.withColumn("x", S.mirrored(F.col("x"), o.width))
    return normal.withColumn("side", F.lit(SIDES[0])).unionByName(flipped.withColumn("side", F.lit(SIDES[1])))


def scores(spark: SparkSession, o: argparse.Namespace) -> None:
    """Each fragment of either side against each target and the target without its short branches. ``--near 1``: only those that
    share a cell with it, for a table whose last row holds one value, below the least score."""
    table = np.loadtxt(o.table, delimiter=",", ndmin=2)  # first row: angles; first column: distances
    frags = _sides(spark, o).withColumn("skel", F.concat_ws("|", "side", "skel"))
    sizes = frags.groupBy("skel").agg(F.count("*").alias("frag_points")).filter(F.col("frag_points") > o.least_points)
    queries = files.read_back(_dotprops(frags.join(sizes, "skel", "left_semi"), 3), "queries")
    out = sizes.withColumnRenamed("skel", "query")
    pairs = None
    for name, folder in (("score_full", o.targets), ("score_pruned", o.pruned)):
        score = partial(N.similarity_of_near, fill=False) if o.near else K.similarity
        one = score(queries, _dotprops(files.read_swc(spark, folder), 5), table[1:, 1:], table[1:, 0], table[0, 1:], ids="string").withColumnRenamed("score", name)
        pairs = one if pairs is None else pairs.join(one, ["query", "target"], "full_outer" if o.near else "inner")
    if o.near:  # what is far from one form of the target may be near the other
        pairs = pairs.fillna(N.far_score(table[1:, 1:]), ["score_full", "score_pruned"])
    key = F.split("query", r"\|")
    rows = pairs.join(out, "query").select(F.col("target").alias("em_id"), key[0].alias("side"), S.volume_of(key[1]).alias("lm_vol"), S.fragment_of(key[1]).alias("frag_id"), "frag_points", "score_full", "score_pruned")
    rows.filter(FI.either_score(o.least_score, "score_full", "score_pruned")).write.parquet(o.out)


def _tables(spark: SparkSession, o: argparse.Namespace) -> tuple[search.SearchOptions, DataFrame, DataFrame, DataFrame]:
    """Options, the targets' weighted points, the fragments' points and colours."""
    options = search.SearchOptions(**{f.name: getattr(o, f.name) for f in fields(search.SearchOptions)})
    em = files.read_swc(spark, o.targets).withColumnRenamed("skel", "skel_id")
    weights = K.per_skeleton(em, K.weigh, "skel_id string, node_id int, weight double")
    points = em.join(weights, ["skel_id", "node_id"]).select(F.col("skel_id").alias("em_id"), F.col("node_id").alias("em_pt"), "x", "y", "z", F.col("weight").alias("seg_len"))
    frags = _sides(spark, o).select("side", S.volume_of(F.col("skel")).alias("lm_vol"), S.fragment_of(F.col("skel")).alias("frag_id"), F.col("node_id").alias("fp"), "x", "y", "z")
    return options, files.read_back(points, "points"), files.read_back(frags, "fragments"), spark.read.parquet(o.colors)


def match(spark: SparkSession, o: argparse.Namespace) -> None:
    """Filters, coverage, matching and ranking: the entries of all targets."""
    options, points, frags, colors = _tables(spark, o)
    found = search.entries(spark.read.parquet(o.scores), points, frags, colors, options)
    search.ranked(files.read_back(found, "entries"), options).write.parquet(o.out)


def follow(spark: SparkSession, o: argparse.Namespace) -> None:
    """The same, some volumes at a time: run again after it was stopped, it goes on with the volumes that are left. The ranking
    is in the folder ``ranked`` of the result; with ``--again`` all volumes are scored anew."""
    options, points, frags, colors = _tables(spark, o)
    progress.deal_by_volume(spark.read.parquet(o.scores), f"{o.out}/scores", o.volumes_per_batch)

    def score(batch: DataFrame) -> DataFrame:
        near = frags.join(batch.select("lm_vol").distinct(), "lm_vol", "left_semi")
        return search.entries(batch, points, near, colors, options)

    progress.follow(spark, f"{o.out}/scores", o.out, score)
    search.ranked(progress.entries(spark, o.out), options).write.mode("overwrite").parquet(f"{o.out}/ranked")


def report(spark: SparkSession, o: argparse.Namespace) -> None:
    """The best volumes of each target as comma-separated files, a folder each."""
    rows = spark.read.parquet(o.entries).filter((F.col("cov_score") < 0) & (F.col("position") < o.best))
    rows.select("em_id", F.col("lm_vol").alias("line_name"), F.col("position").alias("rank"), "cov_score").repartition("em_id").sortWithinPartitions("em_id", "rank").write.partitionBy("em_id").csv(o.out, header=True)


#: stage -> (function, paths it reads, other options with their defaults)
STAGES: dict[str, tuple[Callable, tuple[str, ...], dict[str, object]]] = {
    "small": (small, ("labels",), {"key": "volumes", "least_voxels": 100}),
    "skeletons": (skeletons, ("labels",), {"key": "volumes", "volume": "volume", "least_cable": 0.0}),
    "prune": (prune, ("skeletons",), {"length": 60.0, "rounds": 3}),
    "resample": (resample, ("skeletons",), {"step": 1.0}),
    "spines": (spines, ("skeletons",), {}),
    "colors": (colors, ("labels", "raw"), {"key": "volumes", "raw_key": "volumes/raw", "volume": "volume"}),
    "scores": (scores, ("targets", "pruned", "fragments", "table"), {"width": S.WIDTH, "least_points": 10, "least_score": -0.5, "near": 0}),
    "match": (match, ("targets", "fragments", "scores", "colors"), {"width": S.WIDTH} | {f.name: f.default for f in fields(search.SearchOptions)}),
    "follow": (follow, ("targets", "fragments", "scores", "colors"), {"width": S.WIDTH, "volumes_per_batch": 1000} | {f.name: f.default for f in fields(search.SearchOptions)}),
    "report": (report, ("entries",), {"best": 150}),
}


#: Stages whose result may be there in part.
RESUMED = ("follow",)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    stages = top.add_subparsers(dest="stage", required=True)
    for name, (f, paths, options) in STAGES.items():
        one = stages.add_parser(name, help=f.__doc__)
        one.add_argument("--data", default=os.environ.get("ARBORIX_DATA", "."))
        one.add_argument("--again", action="store_true", help="also where the result is there")
        for path in (*paths, "out"):
            one.add_argument(f"--{path}", required=True)
        for option, default in options.items():
            one.add_argument(f"--{option.replace('_', '-')}", type=type(default), default=default)
    return top


def run(spark: SparkSession, arguments: list[str]) -> bool:
    """Runs a stage; False if its result was there."""
    o = parser().parse_args(arguments)
    f, paths, _ = STAGES[o.stage]
    for path in (*paths, "out"):
        value = getattr(o, path)
        setattr(o, path, value if value.startswith("/") or "://" in value else f"{o.data.rstrip('/')}/{value}")
    fs, place = files.folder_of(o.out)
    if fs.get_file_info(place).is_file or fs.get_file_info(f"{place}").type.name == "Directory":
        if not o.again and o.stage not in RESUMED:
            return False
        if o.again:
            files.remove(spark, o.out)
    f(spark, o)
    return True


def main(arguments: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("arborix").getOrCreate()
    run(spark, arguments)
    spark.stop()


if __name__ == "__main__":
    main()
