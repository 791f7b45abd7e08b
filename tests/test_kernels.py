"""Kernels against hand cases and slow twins."""

import itertools
from collections import Counter

import numpy as np
import pytest

from arborix.operators import graph
from arborix.operators import kernels as K
from arborix.operators import selection as SEL


def test_capacity_keeps_the_six_nearest():
    em = np.array([[float(k), 0, 0] for k in range(10)])
    assert K.greedy_cover(em, np.array([[0.0, 0, 0]]), 25).tolist() == [0, 1, 2, 3, 4, 5]


def test_greedy_without_fragment_covers_nothing():
    assert len(K.greedy_cover(np.zeros((3, 3)), np.zeros((0, 3)), 25)) == 0


def slow_greedy(em, frag, radius, cap=6):
    """The rounds restated with plain loops."""
    r2 = radius * radius
    d2 = [[sum((a - b) ** 2 for a, b in zip(e, f)) for f in frag] for e in em]
    owner = [min(range(len(frag)), key=lambda f: (d2[e][f], f)) for e in range(len(em))]
    dist = [d2[e][owner[e]] for e in range(len(em))]
    alive = [min(d2[e][f] for e in range(len(em))) < r2 for f in range(len(frag))]
    covered = set()
    for _ in range(int(radius) + 1):
        if not any(alive):
            break
        sets = {f: [e for e in range(len(em)) if owner[e] == f and dist[e] < r2] for f in range(len(frag)) if alive[f]}
        over = [f for f, s in sets.items() if len(s) > cap]
        for f in over:
            for e in sorted(sets[f], key=lambda e: (dist[e], e))[cap:]:
                dist[e] = 100 * r2
        now = {e for e in range(len(em)) if dist[e] < r2}
        if now <= covered:
            break
        covered |= now
        if not over:
            break
        for f in over:
            alive[f] = False
            for e in range(len(em)):
                d2[e][f] = 100 * r2
        for f in over:
            for e in sets[f]:
                owner[e] = min(range(len(frag)), key=lambda g: (d2[e][g], g))
        dist = [d2[e][owner[e]] for e in range(len(em))]
    return sorted(covered)


@pytest.mark.parametrize("seed", range(25))
def test_greedy_like_its_twin(seed):
    rng = np.random.default_rng(seed)
    em, frag = rng.uniform(0, 30, (rng.integers(1, 40), 3)), rng.uniform(0, 30, (rng.integers(1, 8), 3))
    assert K.greedy_cover(em, frag, 9.0, 3).tolist() == slow_greedy(em.tolist(), frag.tolist(), 9.0, 3)


def best_by_enumeration(cost, edge, cap):
    """Least cost over all assignments."""
    n, m = cost.shape
    best = 0.0
    for choice in itertools.product(range(-1, m), repeat=n):
        used = [c for c in choice if c >= 0]
        if all(edge[e, c] for e, c in enumerate(choice) if c >= 0) and all(used.count(f) <= cap for f in range(m)):
            best = min(best, sum(cost[e, c] for e, c in enumerate(choice) if c >= 0))
    return best


@pytest.mark.parametrize("seed", range(40))
def test_optimal_cover_is_optimal(seed):
    rng = np.random.default_rng(seed)
    em, frag = rng.uniform(0, 6, (rng.integers(1, 6), 3)), rng.uniform(0, 6, (rng.integers(1, 4), 3))
    d = np.sqrt(K.distances2(em, frag))
    got = K.optimal_cover(em, frag, 4.0, 1, squared=False, near=10, by_fragment=True)
    # the covered set is one that an optimal assignment covers
    best = best_by_enumeration(d - 4.0, d <= 4.0, 1)
    only = best_by_enumeration((d - 4.0)[got], (d <= 4.0)[got], 1) if len(got) else 0.0
    assert only == pytest.approx(best)


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize(("squared", "near", "by_fragment", "cap"), [(True, 2, False, 2), (False, 3, True, 2), (False, 50, True, 1)])
def test_optimal_forms_are_optimal(seed, squared, near, by_fragment, cap):
    rng = np.random.default_rng(seed)
    em, frag = rng.uniform(0, 6, (rng.integers(1, 7), 3)), rng.uniform(0, 6, (rng.integers(1, 4), 3))
    d2 = K.distances2(em, frag)
    edge = d2 <= 16.0
    for row in range(len(em)) if not by_fragment else range(len(frag)):  # the nearest partners only
        line = d2[row] if not by_fragment else d2[:, row]
        far = [k for nth, k in enumerate(sorted(range(len(line)), key=lambda k: (line[k], k))) if nth >= near]
        if by_fragment:
            edge[far, row] = False
        else:
            edge[row, far] = False
    cost = d2 - 16.0 if squared else np.sqrt(d2) - 4.0
    got = K.optimal_cover(em, frag, 4.0, cap, squared=squared, near=near, by_fragment=by_fragment)
    best = best_by_enumeration(cost, edge, cap)
    assert (best_by_enumeration(cost[got], edge[got], cap) if len(got) else 0.0) == pytest.approx(best)


def test_near_pairs_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    em, frag = rng.uniform(0, 30, (50, 3)), rng.uniform(0, 30, (40, 3))
    whole, cover = K.near_pairs(em, frag, 9.0), K.greedy_cover(em, frag, 9.0, 2).tolist()
    monkeypatch.setattr(K, "BLOCK", 100)
    assert all((a == b).all() for a, b in zip(whole, K.near_pairs(em, frag, 9.0))) and K.greedy_cover(em, frag, 9.0, 2).tolist() == cover


def test_conflict_covers_once():
    assert len(K.optimal_cover(np.zeros((1, 3)), np.ones((2, 3)), 3.0, 1, squared=False, near=5, by_fragment=True)) == 1


def test_unknown_names_are_errors():
    with pytest.raises(ValueError):
        K.cover(np.zeros((1, 3)), np.zeros((1, 3)), 1.0, version="other")
    with pytest.raises(ValueError):
        SEL.select(np.ones(1), np.ones(1), np.ones((1, 1)), np.ones(1), np.ones((1, 3)), clustering="other")


def test_prune_removes_a_tip_as_long_as_the_limit():
    # 1-2-3, and 4 and 5 on 3; 3-4 has length 1, 3-5 length 2
    ids, parents = [1, 2, 3, 4, 5], [-1, 1, 2, 3, 3]
    xyz = np.array([[0, 0, 0], [5, 0, 0], [10, 0, 0], [10, 1, 0], [10, -2, 0]], float)
    assert K.pruned(ids, parents, xyz, 1.0) == {1, 2, 3, 5}
    assert K.pruned(ids, parents, xyz, 0.99) == {1, 2, 3, 4, 5}
    assert K.pruned(ids, parents, xyz, 2.0) == {1, 2, 3}


def test_relabel_is_a_tree_from_a_tip():
    rows = K.depth_first([10, 20, 30, 40], [-1, 10, 20, 20])
    assert rows == [(10, 1, -1), (20, 2, 1), (30, 3, 2), (40, 4, 2)]


def test_relabel_of_two_components():
    rows = K.depth_first([1, 2, 5, 6], [-1, 1, -1, 5])
    assert [r[1] for r in rows] == [1, 2, 3, 4] and [r[2] for r in rows] == [-1, 1, -1, 3]


def test_resample_steps(spark):
    nodes = spark.createDataFrame([(7, 1, -1, 0.0, 0.0, 0.0), (7, 2, 1, 10.0, 0.0, 0.0), (7, 3, 9, 1.0, 1.0, 1.0)], "skel_id long, node_id int, parent_id int, x double, y double, z double")
    rows = sorted((r.node_id, r.x) for r in graph.resampled(nodes, 2.5).collect())
    assert rows == [(1, 0.0), (2, 2.5), (2, 5.0), (2, 7.5), (2, 10.0), (3, 1.0)]


def test_tangents_of_a_line():
    xyz = np.array([[k, 2 * k, 0] for k in range(8)], float)
    assert np.allclose(K.tangents(xyz, 4), np.array([1, 2, 0]) / np.sqrt(5))


def test_unbranched_skeleton_has_one_weight():
    w = K.peeled_weights(np.array([-1, 1, 2, 3]))
    assert (w[:3] > 0).all() and len(set(w.tolist())) == 1


def test_short_twigs_weigh_their_length():
    # a long path of which seven twigs of two points branch off
    parents, twigs = [-1] + list(range(1, 30)), []
    for k in range(7):
        at = len(parents)
        parents += [4 * k + 2, at + 1]
        twigs += [at, at + 1]
    w = K.peeled_weights(np.array(parents))
    assert (w > 0).all() and w[twigs[0]] < w[10]


def slow_weights(parents, last=5, chop=50):
    """Peeling restated with lists: runs of nodes, the shortest that ends in a tip goes first."""
    rest, weight, peeled = [(k, p - 1 if p > 0 else -1) for k, p in enumerate(parents)], [0.0] * len(parents), 1.0
    while rest:
        children = Counter(p for _, p in rest)
        runs = []
        for node, p in rest:
            if p == -1 or children[p] > 1:
                runs.append([])
            runs[-1].append(node)
        if len(runs) <= last:
            ends = [min(len(r) + 1, chop) for r in runs]
            for node, _ in rest:
                weight[node] = max(peeled, (len(rest) - sum(ends)) / len(runs))
            for r, n in zip(runs, ends):
                for node in range(r[-1] - n, r[-1] + 1):
                    weight[node] = n
            return weight
        shortest = min((r for r in runs if children[r[-1]] < 2), key=len)
        peeled = float(len(shortest) + 1)
        for node in shortest:
            weight[node] = peeled
        rest = [(node, p) for node, p in rest if node not in shortest]
    return weight


def tree_in_file_order(rng, n):
    """Parents, 1-based, of a random tree in depth-first order with some long unbranched stretches."""
    children = {0: []}
    for k in range(1, n):
        at = k - 1 if rng.random() < 0.8 else int(rng.integers(0, k))
        children[at].append(k)
        children[k] = []
    out, number, stack = [], {}, [(0, -1)]
    while stack:
        node, parent = stack.pop()
        number[node] = len(out) + 1
        out.append(parent)
        stack += [(c, number[node]) for c in reversed(children[node])]
    return out


@pytest.mark.parametrize("seed", range(30))
def test_weights_like_their_twin(seed):
    rng = np.random.default_rng(seed)
    parents = tree_in_file_order(rng, int(rng.integers(2, 200)))
    assert K.peeled_weights(np.array(parents)).tolist() == slow_weights(parents)


def test_weights_of_several_roots_and_few_segments():
    rng = np.random.default_rng(3)
    for _ in range(200):
        parents = []
        for _ in range(int(rng.integers(1, 4))):
            parents += [p + len(parents) if p > 0 else -1 for p in tree_in_file_order(rng, int(rng.integers(2, 40)))]
        for last in (1, 2, 5):
            assert K.peeled_weights(np.array(parents), last=last).tolist() == slow_weights(parents, last)


def test_weights_of_a_large_skeleton():
    """Ten thousand tips: looking at all nodes for each would take minutes."""
    import time

    parents = tree_in_file_order(np.random.default_rng(5), 100_000)
    assert len(set(range(1, 100_001)) - set(parents)) > 10_000
    began = time.perf_counter()
    assert (K.peeled_weights(np.array(parents)) > 0).all()
    assert time.perf_counter() - began < 10


def test_similarity_of_itself_is_best():
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 100, (20, 3))
    q = np.hstack([p, K.tangents(p)])
    table = np.array([[1.0, 2.0], [0.0, 0.5]])
    assert K.pair_score(q, q, table, np.array([0, 1.0]), np.array([0, 0.5])) == 2.0


@pytest.mark.parametrize("seed", range(10))
def test_tangents_and_scores_like_their_twins(seed, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    rng = np.random.default_rng(seed)
    clouds = [rng.uniform(0, 50, (int(rng.integers(4, 40)), 3)) for _ in range(2)]
    props = []
    for xyz in clouds:
        t = K.tangents(xyz, 4)
        for k, p in enumerate(xyz):
            near = sorted(xyz, key=lambda q, p=p: ((q - p) ** 2).sum())[:4]
            _, _, axes = np.linalg.svd(np.array(near) - np.mean(near, axis=0))
            assert abs(abs(axes[0] @ t[k]) - 1) < 1e-6 or np.linalg.matrix_rank(np.array(near) - np.mean(near, axis=0)) < 1
        props.append(np.hstack([xyz, t]))
    distances, angles, table = np.array([0.0, 10, 20]), np.array([0.0, 0.3, 0.6, 0.9]), rng.uniform(-1, 1, (3, 4))
    total = 0.0
    for q in props[0]:
        d, nearest = min((float(np.sqrt(((q[:3] - p[:3]) ** 2).sum())), k) for k, p in enumerate(props[1]))
        angle = abs(float(q[3:] @ props[1][nearest][3:]))
        total += table[sum(d >= b for b in distances[1:]), sum(angle >= b for b in angles[1:])]
    assert K.pair_score(*props, table, distances, angles) == pytest.approx(total / len(props[0]))


def test_similarity_in_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(s, n, *map(float, rng.uniform(0, 50, 3)), *map(float, v / np.linalg.norm(v))) for s in range(6) for n in range(10) for v in [rng.normal(size=3)]]
    d = spark.createDataFrame(rows, "skel_id long, node_id long, x double, y double, z double, tx double, ty double, tz double")
    table, distances, angles = np.array([[1.0, 2.0], [0.0, 0.5]]), np.array([0, 10.0]), np.array([0, 0.5])
    one, many = (sorted(map(tuple, K.similarity(d, d.filter("skel_id < 4"), table, distances, angles, block=b).collect())) for b in (1000, 7))
    assert one == many and len(one) == 24


def test_color_cost_by_hand():
    d = SEL.color_costs(np.array([[0.0, 0, 0], [10, 5, 0], [100, -50, 0]]))
    assert d[0, 1] == pytest.approx(0.03125) and d[0, 2] == pytest.approx(4.6875)


def test_adjusted_coverage_sums_to_the_whole():
    rng = np.random.default_rng(1)
    values, weights = rng.uniform(0.1, 1, (4, 30)), rng.uniform(1, 2, 30)
    assert SEL.adjusted_coverage(values, weights, 30).sum() == pytest.approx(100 * weights.sum() / 30)


def test_clusters_of_equal_weight():
    points = np.array([[0.0, 0, 0], [1, 0, 0], [50, 0, 0], [51, 0, 0]])
    assert len(set(SEL.ward(points, np.ones(4))[1][:2].tolist())) == 1
    assert SEL.ward(points, np.ones(4))[1].tolist() in ([0, 0, 1, 1], [1, 1, 0, 0])
    label = SEL.kmeans(points, 2)
    assert label[0] == label[1] != label[2] == label[3]


def test_weighted_clusters_count_repeats():
    points = np.array([[0.0, 0, 0], [4, 0, 0], [9, 0, 0]])
    heavy = SEL.ward(points, np.array([1.0, 50, 50]))[1]
    assert heavy[0] == heavy[1] != heavy[2]


@pytest.mark.parametrize("seed", range(20))
def test_selection_beats_the_best_single_fragment(seed):
    rng = np.random.default_rng(seed)
    n, points = rng.integers(2, 9), 40
    hit = rng.random((n, points)) < 0.4
    weights = rng.uniform(0.5, 2, points)
    coverages = 100 * (hit * weights).sum(axis=1) / points
    values, scores = hit * coverages[:, None], rng.uniform(0.5, 2, n)
    colors = rng.integers(1, 255, (n, 3)).astype(float)
    for clustering in ("agglomerative", "kmeans"):
        chosen, energy = SEL.select(scores, coverages, values, weights, colors, clustering=clustering)
        assert chosen and energy <= -(coverages * scores).max() + 1e-9
        # never below the bound without pairwise costs
        adjusted = SEL.adjusted_coverage(values, weights, points) * scores
        if len(chosen) == n:
            assert energy >= -adjusted.sum() - 1e-9


def test_clusters_that_the_other_side_beats_are_skipped():
    # two fragments of one colour on different points: together they are worth more than either
    scores, weights = np.array([1.0, 0.9]), np.ones(10)
    values = np.zeros((2, 10))
    values[0, :5], values[1, 5:] = 50.0, 50.0
    colors = np.array([[200.0, 100, 50], [200.0, 100, 50]])
    for clustering in ("agglomerative", "kmeans"):
        chosen, energy = SEL.select(scores, np.array([50.0, 50.0]), values, weights, colors, clustering=clustering)
        single, least = SEL.select(scores, np.array([50.0, 50.0]), values, weights, colors, clustering=clustering, other_upper=-1000.0)
        assert single == [0] and least == pytest.approx(-50.0)
        assert energy <= least and (clustering == "agglomerative" or sorted(chosen) == [0, 1])


def test_color_center_is_that_of_the_larger_cluster(spark):
    rng = np.random.default_rng(3)
    dark, light = rng.integers(0, 20, (60, 3)), rng.integers(200, 220, (25, 3))
    rows = [(7, *map(int, c)) for c in [*dark, *light]] + [(8, 5, 6, 7)] * 3
    out = {r.label: (r.r, r.g, r.b) for r in SEL.color_modes(spark.createDataFrame(rows, "label int, r int, g int, b int"), ["label"]).collect()}
    assert out[7] == pytest.approx(tuple(dark.mean(axis=0)), abs=1.0) and out[8] == pytest.approx((5, 6, 7), abs=1.0)


def test_cached_table_is_read_again(spark, tmp_path):
    from arborix.sources import volumes

    path, first, other = f"file://{tmp_path}/t", spark.range(5), spark.range(9)
    assert volumes.cached(first, path).count() == 5 and volumes.cached(other, path).count() == 5
