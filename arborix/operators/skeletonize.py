"""Skeletons of labels by the published TEASAR method: paths along the middle from the farthest voxels to a root."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s)]


def boundary_distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each voxel to the nearest one outside, axis by axis. Memory is linear in the box: along an axis
    squares are spread one step further at a time, until no step can lower any."""
    d2 = np.where(np.pad(mask, 1), np.inf, 0.0)
    for axis in range(3):
        before = np.moveaxis(d2, axis, -1)
        out = before.copy()
        for k in range(1, before.shape[-1]):
            if k * k >= out.max():
                break
            np.minimum(out[..., k:], before[..., :-k] + k * k, out=out[..., k:])
            np.minimum(out[..., :-k], before[..., k:] + k * k, out=out[..., :-k])
        d2 = np.moveaxis(out, -1, axis)
    return np.sqrt(d2[1:-1, 1:-1, 1:-1])


def shortest(inside: bytes, steps: list[tuple[int, float]], cost: list[float] | None, root: int) -> tuple[dict[int, float], dict[int, int]]:
    """(distance, predecessor) over 26 neighbours, from places of a box with a border to places; with costs, a step costs that of
    the place it leads to as well."""
    distance, before, queue = {root: 0.0}, {root: -1}, [(0.0, root)]
    while queue:
        d, v = heapq.heappop(queue)
        if d > distance[v]:
            continue
        for off, step in steps:
            w = v + off
            if inside[w]:
                new = d + (step if cost is None else cost[w] + step)
                if new < distance.get(w, np.inf):
                    distance[w], before[w] = new, v
                    heapq.heappush(queue, (new, w))
    return distance, before


def skeleton(voxels: np.ndarray, *, scale: float = 3.0, const: float = 4.0, penalty: float = 5000.0, power: float = 16.0) -> list[tuple[int, tuple, int, float]]:
    """(node from 1 on, voxel, parent or -1, distance to the boundary) of one label's voxels, all its parts."""
    low = voxels.min(axis=0) - 1  # a border of one
    mask = np.zeros(voxels.max(axis=0) - low + 2, bool)
    mask[tuple((voxels - low).T)] = True
    depth = boundary_distance(mask)
    inside, (_, h, w) = mask.tobytes(), mask.shape
    steps = [((z * h + y) * w + x, (z * z + y * y + x * x) ** 0.5) for z, y, x in STEPS]
    cost = np.where(mask, penalty * (1 - depth / (depth.max() * 1.01)) ** power, 0.0).ravel().tolist()
    places = np.flatnonzero(mask.ravel()).tolist()  # in order of z, y, x
    seen, nodes, out = bytearray(len(inside)), {}, []
    for start in places:
        if seen[start]:
            continue
        reach, _ = shortest(inside, steps, None, start)
        for v in reach:
            seen[v] = 1
        root = max(reach, key=lambda v: (reach[v], v))
        far, _ = shortest(inside, steps, None, root)
        _, before = shortest(inside, steps, cost, root)
        gone = np.zeros(mask.shape, bool)
        for tip in sorted(reach, key=lambda v: (-far[v], v)):
            if gone.flat[tip]:
                continue
            path, v = [], tip
            while v >= 0 and v not in nodes:
                path.append(v)
                v = before[v]
            for v in reversed(path):
                nodes[v], parent = len(out) + 1, before[v]
                at = tuple(int(c) for c in np.unravel_index(v, mask.shape))
                inner = float(depth[at])
                out.append((nodes[v], tuple(int(c + o) for c, o in zip(at, low, strict=True)), nodes[parent] if parent >= 0 else -1, inner))
                r = scale * inner + const
                ball = [np.arange(max(0, int(c - r)), min(n, int(c + r) + 1)) for c, n in zip(at, mask.shape, strict=True)]
                away = [(b - c) ** 2 for b, c in zip(ball, at, strict=True)]
                gone[ball[0][0] : ball[0][-1] + 1, ball[1][0] : ball[1][-1] + 1, ball[2][0] : ball[2][-1] + 1] |= away[0][:, None, None] + away[1][:, None] + away[2] <= r * r
    return out


def skeletonize(voxels: DataFrame, group: list[str], *, least_cable: float = 0.0, scale: float = 3.0, const: float = 4.0) -> DataFrame:
    """(group, node_id, x, y, z, radius, parent_id) of each label other than 0 whose cable is longer than ``least_cable``.

    A label is one group: fragments are bounded by their volume. Axes are written reversed: x, y, z.
    """
    types = dict(voxels.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = skeleton(pdf[["z", "y", "x"]].drop_duplicates().to_numpy(np.int64), scale=scale, const=const)
        at = {n: np.array(v, float) for n, v, _, _ in rows}
        cable = sum(float(np.linalg.norm(at[n] - at[p])) for n, _, p, _ in rows if p != -1)
        kept = rows if cable > least_cable else []
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in group), n, float(v[2]), float(v[1]), float(v[0]), r, p) for n, v, p, r in kept], columns=[*group, "node_id", "x", "y", "z", "radius", "parent_id"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in group), "node_id int, x double, y double, z double, radius double, parent_id int"])
    return voxels.filter(F.col(group[-1]) != 0).groupBy(*group).applyInPandas(run, schema)
