"""Choosing the fragments of a volume that reproduce a target together: colour clusters, then greedy removal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans(points: np.ndarray, k: int, weights: np.ndarray | None = None, *, starts: int = 5, tolerance: float = 1e-2, seed: int = 0) -> np.ndarray:
    """Labels of weighted k-means, the best of several seeded starts."""
    n = len(points)
    w = np.ones(n) if weights is None else np.maximum(weights, 1e-12)
    k, best, rng = min(k, n), (np.inf, np.zeros(n, int)), np.random.default_rng(seed)
    spread = tolerance * max(points.var(axis=0).mean(), 1e-12)
    for _ in range(starts):
        centers = points[[rng.choice(n, p=w / w.sum())]]
        while len(centers) < k:
            d2 = ((points[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1) * w
            centers = np.vstack([centers, points[rng.choice(n, p=d2 / d2.sum()) if d2.sum() > 0 else rng.integers(n)]])
        for _ in range(300):
            label = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([np.average(points[label == j], axis=0, weights=w[label == j]) if (label == j).any() else centers[j] for j in range(k)])
            moved, centers = ((new - centers) ** 2).sum(), new
            if moved <= spread:
                break
        d2 = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
        label = d2.argmin(axis=1)
        cost = (d2.min(axis=1) * w).sum()
        if cost < best[0] - 1e-12:
            best = (cost, label)
    return best[1]


def ward(points: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Labels of every cut of Ward's tree, of 1, 2, ... clusters; a weight is how often a point counts."""
    label = np.arange(len(points))
    center, mass, cuts = points.astype(float).copy(), weights.astype(float).copy(), {len(points): np.arange(len(points))}
    active = list(range(len(points)))
    while len(active) > 1:
        c, m = center[active], mass[active]
        gain = ((c[:, None] - c[None]) ** 2).sum(axis=2) * (m[:, None] * m[None] / (m[:, None] + m[None]))
        gain[np.tril_indices(len(active))] = np.inf
        i, j = np.unravel_index(gain.argmin(), gain.shape)
        a, b = active[i], active[j]
        center[a] = (center[a] * mass[a] + center[b] * mass[b]) / (mass[a] + mass[b])
        mass[a] += mass[b]
        label = np.where(label == b, a, label)
        active.remove(b)
        cuts[len(active)] = np.unique(label, return_inverse=True)[1]
    return [cuts[k] for k in range(1, len(points) + 1)]


def color_costs(colors: np.ndarray, bin_size: float = 32.0, slack: float = 16.0) -> np.ndarray:
    """Costs of all pairs of a volume's fragments."""
    d = colors[:, None] - colors[None]
    low, high = d.min(axis=2), d.max(axis=2)
    one_way = (low > -slack) | (high < slack)
    out = np.where(one_way, 0.1 * np.abs(d).max(axis=2) / bin_size, (high - low) / bin_size)
    out = np.triu(out, 1)
    return out + out.T


def adjusted_coverage(values: np.ndarray, weights: np.ndarray, total: int) -> np.ndarray:
    """Percent of each fragment when every point goes to the largest positive value (fragments x points)."""
    winner = values.argmax(axis=0)
    some = values[winner, np.arange(values.shape[1])] > 0
    return 100.0 * np.bincount(winner[some], weights=weights[some], minlength=len(values)) / total


def energy_of(chosen: np.ndarray, scores: np.ndarray, values: np.ndarray, weights: np.ndarray, costs: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(adjusted unaries, weighted pairwise costs) of a set of fragments."""
    unary = adjusted_coverage(values[chosen], weights, total) * scores[chosen]
    return unary, 0.5 / max(1, len(chosen) - 1) * unary * costs[np.ix_(chosen, chosen)].sum(axis=1)


def select(scores: np.ndarray, coverages: np.ndarray, values: np.ndarray, weights: np.ndarray, colors: np.ndarray, *, clustering: str = "agglomerative", other_upper: float = 0.0) -> tuple[list[int], float]:
    """(fragments, energy) of the best set. values: fragments x points, what each is worth at a point."""
    if clustering not in ("agglomerative", "kmeans"):
        raise ValueError(f"no clustering {clustering!r}")
    total, unary = values.shape[1], coverages * scores
    jitter = colors + 0.001 * np.arange(len(colors))[:, None]
    bright = jitter * 255.0 / jitter.max(axis=1, keepdims=True)
    costs, most = color_costs(bright), min(10, len(np.unique(bright, axis=0)) + 1)
    best, chosen = -float(unary.max()), [int(unary.argmax())]
    if clustering == "agglomerative":
        cuts = ward(bright, np.maximum(1, np.rint(unary + 1)))
        clusterings = [cuts[k - 1] for k in range(min(most, len(bright)), 1, -1)]
    else:
        clusterings = [kmeans(bright, k, unary) for k in range(1, most)]
    for labels in clusterings:
        for label in range(labels.max() + 1):
            members = np.flatnonzero(labels == label)
            limit = min(best, other_upper)
            if not len(members) or -unary[members].sum() >= limit:
                continue
            while len(members):
                adjusted, pairwise = energy_of(members, scores, values, weights, costs, total)
                if -adjusted.sum() >= limit:  # no removal can make it better than what there is
                    members = members[:0]
                    break
                over = next((u for u in (unary[members], adjusted) if (pairwise >= u).any()), None)
                if over is None:
                    break
                members = np.delete(members, (pairwise - over).argmax())
            if len(members):
                energy = float(-adjusted.sum() + pairwise.sum())
                if energy < best:
                    best, chosen = energy, members.tolist()
    return chosen, best


def best_fragments(covered: DataFrame, fragments: DataFrame, points: DataFrame, *, keys: tuple[str, ...] = ("em_id", "lm_vol"), clustering: str = "agglomerative") -> DataFrame:
    """A match entry for each group: frag_ids, cov_score, aggregate_coverage, n_fragments.

    covered: keys, frag_id, em_pt, seg_len. fragments: keys, frag_id, score, r, g, b and, where the other side of a volume
    limits the search, other_upper. points: points by em_id. A group is one target's fragments in one volume, side and
    variant. The value of a fragment at a point is its coverage.
    """
    if "other_upper" not in fragments.columns:
        fragments = fragments.withColumn("other_upper", F.lit(0.0))
    group, types = list(keys), dict(fragments.dtypes)
    per = covered.groupBy(*group, "frag_id").agg(F.collect_list("em_pt").alias("pts"), F.collect_list("seg_len").alias("w"), F.sum("seg_len").alias("sum_w"))
    rows = per.join(fragments, [*group, "frag_id"]).join(points, "em_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frag_id", kind="stable").reset_index(drop=True)
        total, n = int(pdf["points"].iloc[0]), len(pdf)
        ids = np.unique(np.concatenate(pdf["pts"].to_list()))
        values, weights = np.zeros((n, total)), np.zeros(total)  # points that nothing covers win nothing
        coverages = 100.0 * pdf["sum_w"].to_numpy(float) / total
        for k, (pts, w) in enumerate(zip(pdf["pts"], pdf["w"], strict=True)):
            at = np.searchsorted(ids, pts)
            values[k, at], weights[at] = coverages[k], w
        chosen, energy = select(pdf["score"].to_numpy(float), coverages, values, weights, pdf[["r", "g", "b"]].to_numpy(float), clustering=clustering, other_upper=float(pdf["other_upper"].iloc[0]))
        together = (values[chosen] > 0).any(axis=0)
        entry = [int(pdf["frag_id"].iloc[c]) for c in chosen], energy, 100.0 * weights[together].sum() / total, n
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in group), *entry)], columns=[*group, "frag_ids", "cov_score", "aggregate_coverage", "n_fragments"])

    schema = ", ".join([*(f"{c} {types[c]}" for c in group), "frag_ids array<long>", "cov_score double", "aggregate_coverage double", "n_fragments int"])
    return rows.groupBy(*group).applyInPandas(run, schema)


def color_modes(voxels: DataFrame, group: list[str]) -> DataFrame:
    """(group, r, g, b): the centre of the larger of two k-means clusters of a label's colours.

    Equal colours are counted first, and the counts are the weights: a label of
    any number of voxels is a table of its different colours.
    """
    counts = voxels.groupBy(*group, "r", "g", "b").agg(F.count("*").alias("n"))
    types = dict(voxels.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "g", "b"])
        points, w = pdf[["r", "g", "b"]].to_numpy(float), pdf["n"].to_numpy(float)
        label = kmeans(points, 2, w, starts=10, tolerance=1e-4)
        large = np.bincount(label, weights=w).argmax()
        center = np.average(points[label == large], axis=0, weights=w[label == large])
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in group), *center]], columns=[*group, "r", "g", "b"])

    return counts.groupBy(*group).applyInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in group), "r double", "g double", "b double"]))
