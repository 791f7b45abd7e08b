"""The matching question as plans: which volumes reproduce a target best."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters, ranking


@dataclass(frozen=True)
class Options:
    """Thresholds of a match; the defaults are those of a production run."""

    score_threshold: float = -0.5
    least_score: float = -1.0
    most_score: float = 1.0
    score_factor: float = 1.0
    least_coverage: float = 0.1
    least_unary: float = 0.0
    energy_threshold: float = -40.0
    top: int = 10


def fragment_energies(scores: DataFrame, options: Options, score: str = "score_full") -> DataFrame:
    """Fragments that pass the score, coverage and unary filters, with their unary."""
    shifted = scalars.shifted_score(F.col(score), most=options.most_score, factor=options.score_factor, least=options.least_score)
    least = scalars.shifted_threshold(options.score_threshold, factor=options.score_factor, least=options.least_score)
    kept = scores.withColumn("s", shifted).filter((F.col("s") > F.lit(least)) & (F.col("coverage") > F.lit(options.least_coverage)))
    return kept.withColumn("unary", scalars.unary(F.col("s"), F.col("coverage"))).filter(F.col("unary") > F.lit(options.least_unary))


def volume_bounds(scores: DataFrame, options: Options, score: str = "score_full") -> DataFrame:
    """(em_id, lm_vol, bound, upper, n) of volumes whose optimistic energy reaches the threshold."""
    energies = fragment_energies(scores, options, score)
    grouped = energies.groupBy("em_id", "lm_vol").agg((-F.sum("unary")).alias("bound"), (-F.max("unary")).alias("upper"), F.count("*").alias("n"))
    # a sum depends on its order in the last digits: the threshold does not
    return grouped.filter(F.round("bound", 6) <= F.lit(options.energy_threshold))


def rank_volumes(scores: DataFrame, options: Options = Options(), score: str = "score_full") -> DataFrame:
    """The best volumes of each target by optimistic energy: one aggregate, and a limit for each target before the shuffle."""
    bounds = volume_bounds(scores, options, score).withColumn("bound", F.round("bound", 6))
    return ranking.top(bounds, "em_id", options.top, F.col("bound"), F.col("lm_vol")).select("em_id", "lm_vol", "bound", "n", "rank")


def rank_both_sides(normal: DataFrame, flipped: DataFrame, options: Options = Options()) -> DataFrame:
    """Volumes of both sides: a side that the other makes hopeless is skipped, and the better one counts."""
    sides = None
    for side, scores in (("normal", normal), ("flipped", flipped)):
        one = volume_bounds(scores, options).withColumn("side", F.lit(side))
        sides = one if sides is None else sides.unionByName(one)
    rows = sides.select("em_id", "lm_vol", "side", F.round("bound", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")
    kept = filters.skip_worse_side(rows).select("em_id", "lm_vol", "lower", F.col("side").alias("side"), "n")
    best = ranking.best_of(kept.withColumn("tie", F.when(F.col("side") == "normal", 0).otherwise(1)), ["em_id", "lm_vol"], "lower", "tie")
    return ranking.top(best, "em_id", options.top, F.col("lower"), F.col("lm_vol")).select("em_id", "lm_vol", "lower", (F.col("side") == "flipped").alias("mirrored"), "n", "rank")


def rank_merged(scores: DataFrame, options: Options = Options(), lead: int = 10) -> DataFrame:
    """Ranking by full scores into which matches by pruned scores move up where they lead by enough."""
    parts = {}
    for score in ("score_full", "score_pruned"):
        bounds = volume_bounds(scores, options, score).withColumn("bound", F.round("bound", 6))
        parts[score] = ranking.ranked(bounds, "em_id", F.col("bound"), F.col("lm_vol")).select("em_id", "lm_vol", "bound", "rank")
    merged = ranking.merged_ranks(parts["score_full"], parts["score_pruned"], "em_id", "lm_vol", lead=lead)
    return merged.select("em_id", "lm_vol", "bound", "nblast_pruned", "merged_rank", "position")
