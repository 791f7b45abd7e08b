"""Kernels of large groups hold what they need, not all near pairs, and give what small ones do."""

import tracemalloc

import numpy as np
import pytest

from arborix.operators import kernels as K


@pytest.mark.parametrize("by_fragment", [False, True])
def test_nearest_pairs_by_tree(monkeypatch, by_fragment):
    rng = np.random.default_rng(6)
    em, frag = rng.integers(0, 9, (150, 3)).astype(float), rng.integers(0, 9, (90, 3)).astype(float)  # ties
    small = K.nearest_pairs(em, frag, 3.0, 5, by_fragment)
    monkeypatch.setattr(K, "LARGE", 0)
    assert all((a == b).all() for a, b in zip(small, K.nearest_pairs(em, frag, 3.0, 5, by_fragment), strict=True))


def test_large_groups_hold_no_matrix_of_pairs(monkeypatch):
    monkeypatch.setattr(K, "near_pairs", lambda *a: pytest.fail("all near pairs of a large group"))
    monkeypatch.setattr(K, "distances2", lambda *a: pytest.fail("all distances of a large group"))
    xyz = np.random.default_rng(7).normal(0, 20, (2000, 3))
    K.nearest_pairs(xyz, xyz + 0.5, 25.0, 5, False)
    assert K.tangents(xyz).shape == xyz.shape


def test_tangents_by_tree(monkeypatch):
    xyz = np.random.default_rng(8).normal(0, 20, (400, 3))
    small = K.tangents(xyz)
    monkeypatch.setattr(K, "LARGE", 0)
    assert np.allclose(small, K.tangents(xyz), atol=1e-9)


def test_similarity_shares_a_large_query(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(s, *map(float, rng.normal(0, 10, 6))) for s, n in ((1, 60), (2, 9)) for _ in range(n)]
    df = spark.createDataFrame(rows, "skel_id long, x double, y double, z double, tx double, ty double, tz double")
    table, edges, angles = rng.random((4, 3)), np.array([0.0, 3, 6, 12]), np.array([0.0, 0.3, 0.6])
    monkeypatch.setattr(K, "PIECE", 10)
    held = {s: np.array([r[1:] for r in rows if r[0] == s]) for s in (1, 2)}
    for r in K.similarity(df, df, table, edges, angles, block=20).collect():
        assert abs(r.score - K.pair_score(held[r.query], held[r.target], table, edges, angles)) < 1e-12


@pytest.mark.parametrize("grid", [False, True])
def test_greedy_coverage_by_tree(monkeypatch, grid):
    rng = np.random.default_rng(10)
    em, frag = (rng.integers(0, 7, (n, 3)).astype(float) if grid else rng.random((n, 3)) * 7 for n in (200, 40))
    small = K.greedy_cover(em, frag, 3.0, 2).tolist()
    monkeypatch.setattr(K, "LARGE", 0)
    assert small and K.greedy_cover(em, frag, 3.0, 2).tolist() == small


def test_greedy_coverage_holds_no_pairs():
    rng = np.random.default_rng(11)
    em, frag = rng.normal(0, 12.5, (6000, 3)), rng.normal(0, 12.5, (1200, 3))  # 7 million pairs, most of them near
    tracemalloc.start()
    covered = K.greedy_cover(em, frag, 25.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(covered) and peak < 100 << 20


def test_greedy_coverage_passes_points_without_a_place():
    em, frag = np.array([[0.0, 0, 0], [np.nan, 0, 0], [5, 0, 0]]), np.array([[np.nan, 0, 0], [1.0, 0, 0]])
    assert K.greedy_cover(em, frag, 3.0).tolist() == [0]


def test_similarity_scores_a_block_as_its_pairs(spark):
    rng = np.random.default_rng(12)
    rows = [(s, *map(float, rng.normal(0, 10, 6))) for s in range(20) for _ in range(5)]
    df = spark.createDataFrame(rows, "skel_id long, x double, y double, z double, tx double, ty double, tz double")
    table, edges, angles = rng.random((4, 3)), np.array([0.0, 3, 6, 12]), np.array([0.0, 0.3, 0.6])
    held = {s: np.array([r[1:] for r in rows if r[0] == s]) for s in range(20)}
    got = K.similarity(df, df, table, edges, angles).collect()
    assert len(got) == 400 and all(r.score == K.pair_score(held[r.query], held[r.target], table, edges, angles) for r in got)
