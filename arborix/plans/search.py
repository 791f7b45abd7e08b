"""The whole search: from pair scores and points to ranked matches of each target, both sides and both scores.

The cheap filters come first, each an aggregate or a semi join, and only pairs
that pass them reach the kernels; keys are columns all the way, so what one
filter drops cannot shift what another sees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import filters as FI
from ..operators import kernels as K
from ..operators import ranking as R
from ..operators import selection as SEL
from ..sources.files import read_back


@dataclass(frozen=True)
class SearchOptions:
    """Thresholds of a search; the defaults are those of a production run."""

    score_threshold: float = -0.5
    least_score: float = -1.0
    most_score: float = 1.0
    score_factor: float = 1.0
    adaptive_offset: float = -0.1
    adaptive_factor: float = 200.0
    energy_threshold: float = -40.0
    least_aggregate: float = 1.0
    least_coverage: float = 0.1
    least_unary: float = 0.0
    least_points: int = 0
    radius: float = 25.0
    cap: int = 6
    step: float = 1.0
    coverage: str = ""
    clustering: str = "agglomerative"
    lead: int = 10


GROUP = ["em_id", "lm_vol", "side"]
VARIANTS = {"score_full": 0, "score_pruned": 1}


def candidates(scores: DataFrame, em_points: DataFrame, options: SearchOptions) -> DataFrame:
    """Fragments worth a coverage: by score, by score and size, by upper bound, and volumes that can reach the threshold."""
    best = F.greatest(*VARIANTS)
    kept = scores.filter(FI.best_score(options.score_threshold, *VARIANTS) & FI.adaptive_score(options.adaptive_offset, options.adaptive_factor, best, F.col("frag_points")))
    points = em_points.groupBy("em_id").agg(F.count("*").alias("points"))
    shifted = S.shifted_score(best, most=options.most_score, factor=options.score_factor, least=options.least_score)
    bounded = kept.join(points, "em_id").withColumn("upper", S.upper_unary(shifted, F.col("frag_points"), F.col("points")))
    reach = FI.kept_groups(bounded, GROUP, F.col("upper"), options.energy_threshold)
    return reach.filter((F.col("upper") > options.least_unary) & (F.col("frag_points") >= options.least_points)).drop("upper", "points")


def covered_points(candidates_: DataFrame, em_points: DataFrame, frag_points: DataFrame, options: SearchOptions) -> DataFrame:
    """(em_id, side, lm_vol, frag_id, em_pt, seg_len) of the points that candidates cover."""
    weighted = A.rescaled_weights(em_points, "em_id", "seg_len")
    pairs = candidates_.select("em_id", "side", "lm_vol", "frag_id")
    covered = K.coverage(weighted, frag_points, options.radius, keys=("side", "lm_vol", "frag_id"), version=options.coverage, cap=options.cap, step=options.step, pairs=pairs)
    return covered.join(weighted.select("em_id", "em_pt", "seg_len"), ["em_id", "em_pt"])


def scored_fragments(candidates_: DataFrame, covered: DataFrame, points: DataFrame, options: SearchOptions, score: str) -> DataFrame:
    """One variant's fragments with coverage, damped score and unary, after the filters that need coverage."""
    least = S.shifted_threshold(options.score_threshold, factor=options.score_factor, least=options.least_score)
    coverages = A.fragment_coverage(covered, points, "em_id", ["side", "lm_vol", "frag_id"], "seg_len").filter(F.col("coverage") > options.least_coverage)
    rows = candidates_.withColumn("s", S.shifted_score(F.col(score), most=options.most_score, factor=options.score_factor, least=options.least_score)).filter(F.col("s") > least)
    rows = rows.join(coverages, ["em_id", "side", "lm_vol", "frag_id"])
    seen = covered.join(rows.select(*GROUP, "frag_id"), [*GROUP, "frag_id"], "left_semi")
    enough = FI.covered_groups(seen, GROUP, "em_pt", "seg_len", points, options.least_aggregate)
    rows = rows.join(enough.select(*GROUP), GROUP, "left_semi").withColumn("unary", S.unary(F.col("s"), F.col("coverage"))).filter(F.col("unary") > options.least_unary)
    rows = FI.kept_groups(rows, GROUP, F.col("unary"), options.energy_threshold)
    damped = rows.withColumn("score", S.damped_score(F.col("s"), F.col("coverage")))
    return damped.withColumn("unary", S.unary(F.col("score"), F.col("coverage"))).select(*GROUP, "frag_id", "score", "coverage", "unary")


def side_bounds(fragments: DataFrame, covered: DataFrame, points: DataFrame) -> DataFrame:
    """(group, lower, upper): what a side's energy lies between."""
    seen = covered.join(fragments.select(*GROUP, "frag_id", "score"), [*GROUP, "frag_id"])
    adjusted = A.adjusted_coverage(seen, points, "em_id", ["lm_vol", "side"], "frag_id", "em_pt", "seg_len", "score")
    adjusted = adjusted.join(fragments.select(*GROUP, "frag_id", "score"), [*GROUP, "frag_id"]).withColumn("adjusted", S.unary(F.col("score"), F.col("coverage")))
    return A.bounds(fragments, adjusted, GROUP, "unary", "adjusted")


def entries(scores: DataFrame, em_points: DataFrame, frag_points: DataFrame, colors: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(variant, em_id, lm_vol, frag_ids, cov_score, aggregate_coverage, n_fragments, mirrored) of every scored volume; without a match cov_score is 0."""
    points = em_points.groupBy("em_id").agg(F.count("*").alias("points"))
    able = read_back(candidates(scores, em_points, options), "candidates")
    covered = read_back(covered_points(able, em_points, frag_points, options), "covered")  # the kernel runs once for both variants
    every, out = scores.select("em_id", "lm_vol").distinct(), None
    for score, variant in VARIANTS.items():
        fragments = scored_fragments(able, covered, points, options, score)
        bounds = FI.skip_worse_side(side_bounds(fragments, covered, points))
        chosen = fragments.join(bounds.select(*GROUP, F.coalesce("other_upper", F.lit(0.0)).alias("other_upper")), GROUP)
        colored = chosen.join(colors, ["lm_vol", "frag_id"])
        found = SEL.best_fragments(covered, colored.select(*GROUP, "frag_id", "score", "r", "g", "b", "other_upper"), points, keys=tuple(GROUP), clustering=options.clustering)
        first = found.withColumn("tie", F.when(F.col("side") == "normal", 0).otherwise(1))
        best = R.best_of(first, ["em_id", "lm_vol"], "cov_score", "tie").withColumn("mirrored", F.col("side") == "flipped").drop("side", "tie")
        one = R.with_defaults(every, best, ["em_id", "lm_vol"], "cov_score").withColumn("variant", F.lit(variant))
        out = one if out is None else out.unionByName(one)
    return out


def ranked(found: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Entries of both variants as one ranking of each target's volumes; entries without a match stay last."""
    by = {v: R.ranked(found.filter(F.col("variant") == v), "em_id", F.col("cov_score"), F.col("lm_vol")) for v in VARIANTS.values()}
    merged = R.merged_ranks(by[0].select("em_id", "lm_vol", "rank"), by[1].select("em_id", "lm_vol", "rank"), "em_id", "lm_vol", lead=options.lead)
    place = merged.select("em_id", "lm_vol", F.col("nblast_pruned").cast("int").alias("variant"), "nblast_pruned", "merged_rank", "position")
    return place.join(found, ["em_id", "lm_vol", "variant"]).drop("variant")
