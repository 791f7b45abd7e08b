"""The k-d tree and the index of near pairs against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.operators import kdtree, kernels, near


def dense(points, queries):
    d2 = (queries[:, None, 0] - points[None, :, 0]) ** 2
    for c in (1, 2):
        d2 += (queries[:, None, c] - points[None, :, c]) ** 2
    return d2


@pytest.mark.parametrize("n", [1, 2, 24, 25, 100, 3000])
@pytest.mark.parametrize("kind", ["normal", "ties", "same"])
def test_tree_is_all_distances(n, kind):
    rng = np.random.default_rng(n)
    points, queries = rng.normal(size=(n, 3)), rng.normal(size=(400, 3)) * 2
    if kind == "ties":
        points, queries = np.round(points * 2), np.round(queries * 2)
    if kind == "same":
        points[:] = points[0]
    found, d2 = kdtree.Tree(points).nearest(queries)
    every = dense(points, queries)
    assert (found == every.argmin(axis=1)).all() and (d2 == every.min(axis=1)).all()


def test_tree_of_nothing():
    assert kdtree.Tree(np.zeros((0, 3))).nearest(np.zeros((2, 3)))[1].tolist() == [np.inf] * 2
    assert len(kdtree.Tree(np.zeros((5, 3))).nearest(np.zeros((0, 3)))[0]) == 0


def test_nearest_in_group(spark):
    rng = np.random.default_rng(5)
    left = [(int(g), k, *map(float, np.round(p))) for k, (g, p) in enumerate(zip(rng.integers(0, 4, 600), rng.normal(size=(600, 3)) * 9, strict=True))]
    right = [(int(g), k, *map(float, np.round(p))) for k, (g, p) in enumerate(zip(rng.integers(1, 5, 300), rng.normal(size=(300, 3)) * 9, strict=True))]
    tables = spark.createDataFrame(left, "g int, fp int, x double, y double, z double"), spark.createDataFrame(right, "g int, em_pt int, x double, y double, z double")
    want = set()
    for g, fp, *p in left:
        some = [(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), k) for h, k, *q in right if h == g]
        if some:
            d2, k = min(some)
            want.add((g, fp, k, d2))
    for block in (7, 100_000):
        assert {tuple(r) for r in kdtree.nearest_in_group(*tables, ["g"], "fp", "em_pt", block).collect()} == want


def test_scores_by_tree_and_by_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    q, t = (np.hstack([np.round(rng.normal(size=(n, 3)) * 5), rng.normal(size=(n, 3))]) for n in (300, 200))
    table, edges, angles = rng.normal(size=(4, 3)), np.array([0, 2.0, 4, 8]), np.array([0, 0.3, 0.6])
    one = kernels.pair_score(q, t, table, edges, angles)
    monkeypatch.setattr(kernels, "LARGE", 0)
    assert kernels.pair_score(q, t, table, edges, angles) == one


@pytest.fixture(scope="module")
def skeletons(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(40):
        center = rng.uniform(0, 200, 3)
        points, tangents = center + rng.normal(size=(30, 3)) * 6, rng.normal(size=(30, 3))
        tangents /= np.linalg.norm(tangents, axis=1)[:, None]
        rows += [(s, k, *map(float, p), *map(float, t)) for k, (p, t) in enumerate(zip(points, tangents, strict=True))]
    return spark.createDataFrame(rows, "skel_id long, node_id long, x double, y double, z double, tx double, ty double, tz double")


EDGES, ANGLES = np.array([0.0, 3, 8, 15]), np.array([0, 0.25, 0.5, 0.75])
TABLE = np.array([[0.6, 0.7, 0.8, 1.0], [0.2, 0.3, 0.4, 0.5], [-0.3, -0.2, -0.1, 0.0], [-1, -1, -1, -1.0]])


def scores(df):
    return {(r.query, r.target): r.score for r in df.collect()}


def test_near_scores_are_those_of_all_pairs(skeletons):
    want = scores(kernels.similarity(skeletons, skeletons.filter("skel_id < 25"), TABLE, EDGES, ANGLES))
    for block in (100_000, 200):
        targets = skeletons.filter("skel_id < 25")
        got = scores(near.similarity_of_near(skeletons, targets, TABLE, EDGES, ANGLES, block=block))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        computed = scores(near.similarity_of_near(skeletons, targets, TABLE, EDGES, ANGLES, block=block, fill=False))
        assert len(computed) < len(want) / 3 and all(want[k] == -1.0 for k in want.keys() - computed.keys())
        assert computed.keys() == {(r.query, r.target) for r in near.near_pairs(skeletons, targets, 15.0).collect()}


def test_no_pair_is_near(spark, skeletons):
    apart = skeletons.withColumn("x", F.col("x") + 10_000)
    assert set(scores(near.similarity_of_near(skeletons, apart, TABLE, EDGES, ANGLES)).values()) == {-1.0}
    assert near.similarity_of_near(skeletons, apart, TABLE, EDGES, ANGLES, fill=False).count() == 0
    assert near.similarity_of_near(skeletons.filter("skel_id < 0"), apart, TABLE, EDGES, ANGLES).count() == 0


def test_a_table_without_one_far_score(skeletons):
    with pytest.raises(ValueError, match="last row"):
        near.similarity_of_near(skeletons, skeletons, TABLE[:3], EDGES[:3], ANGLES)
