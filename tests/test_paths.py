"""Spines and even resampling against walks over the trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arborix.operators import paths
from arborix.sources import files


def tree(rng, n, branching, skel):
    rows = []
    for k in range(1, n + 1):
        parent = -1 if k == 1 else (k - 1 if rng.random() > branching else rng.randrange(1, k))
        rows.append((skel, k * 3, 0, rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(0, 50), float(k), parent * 3 if parent > 0 else -1))
    return rows


SCHEMA = "skel_id string, node_id int, node_type int, x double, y double, z double, radius double, parent_id int"


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(8)
    rows = []
    for k in range(14):
        rows += tree(rng, rng.choice([1, 2, 3, 30, 60]), rng.choice([0.0, 0.2, 0.6, 1.0]), f"s{k}")
    two = tree(rng, 20, 0.3, "two") + [(s, n + 1000, t, x, y, z, r, p + 1000 if p > 0 else -1) for s, n, t, x, y, z, r, p in tree(rng, 30, 0.3, "two")]
    return rows + two


def by_skeleton(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], {})[r[1]] = r
    return out


def distances(nodes, start):
    near = {n: [] for n in nodes}
    for n, r in nodes.items():
        if r[7] != -1:
            d = math.dist(r[3:6], nodes[r[7]][3:6])
            near[n].append((r[7], d))
            near[r[7]].append((n, d))
    found, todo, via = {start: 0.0}, [start], {start: None}
    while todo:
        n = todo.pop()
        for m, d in near[n]:
            if m not in found:
                found[m], via[m] = found[n] + d, n
                todo.append(m)
    return found, via


def test_spine_is_the_longest_path(spark, forest):
    got = {}
    for r in paths.spine(spark.createDataFrame(forest, SCHEMA)).collect():
        got.setdefault(r.skel_id, {})[r.node_id] = r
    for skel, nodes in by_skeleton(forest).items():
        every = {n: distances(nodes, n) for n in nodes}
        a, b = max(((a, b) for a in nodes for b in every[a][0] if a <= b), key=lambda p: every[p[0]][0][p[1]])
        way = [b]
        while (up := every[a][1][way[-1]]) is not None:
            way.append(up)
        way.reverse()
        assert {n: r.parent_id for n, r in got[skel].items()} == dict(zip(way, [-1, *way], strict=False))
        assert all(got[skel][n].at == pytest.approx(every[a][0][n]) for n in way)
        assert all(got[skel][n].radius == nodes[n][6] for n in way)


def test_resampled_points_are_even(spark, forest, tmp_path):
    table = spark.createDataFrame(forest, SCHEMA)
    out = paths.resampled(table, 7.0, values=("x", "y", "z", "radius"))
    new = by_skeleton([(r.skel_id, r.node_id, 0, r.x, r.y, r.z, r.radius, r.parent_id) for r in out.collect()])
    for skel, nodes in by_skeleton(forest).items():
        children = {n: [m for m, r in nodes.items() if r[7] == n] for n in nodes}
        keys = {n for n, r in nodes.items() if r[7] == -1 or len(children[n]) != 1}
        assert keys <= set(new[skel]) and all(new[skel][n][3:7] == nodes[n][3:7] for n in keys)
        want = set(keys)
        for lower in keys:
            if nodes[lower][7] == -1:
                assert new[skel][lower][7] == -1
                continue
            way = [lower]  # up to the next key
            while True:
                way.append(nodes[way[-1]][7])
                if way[-1] in keys:
                    break
            total = sum(math.dist(nodes[a][3:6], nodes[b][3:6]) for a, b in zip(way, way[1:]))  # noqa: B905
            chain = [lower]
            while new[skel][chain[-1]][7] not in keys:
                chain.append(new[skel][chain[-1]][7])
            assert new[skel][chain[-1]][7] == way[-1]
            want |= set(chain)
            if total <= 7.0:
                assert chain == way[:-1]
                continue
            chain.reverse()
            assert len(chain) == math.ceil(total / 7.0)
            down = way[::-1]
            for k, n in enumerate(chain[:-1], 1):  # at k * 7 from above, on the old lines
                left, at = k * 7.0, 0
                while left > (d := math.dist(nodes[down[at]][3:6], nodes[down[at + 1]][3:6])):
                    left, at = left - d, at + 1
                a, b = nodes[down[at]], nodes[down[at + 1]]
                assert new[skel][n][3:7] == pytest.approx([p + (q - p) * left / d for p, q in zip(a[3:7], b[3:7], strict=True)], abs=1e-6)
        assert set(new[skel]) == want
    # a skeleton file each, and back
    named = out.withColumnsRenamed({"skel_id": "skel", "radius": "diameter"}).withColumns({"node_type": F.lit(0)})
    files.write_swc(named, f"file://{tmp_path}/out")
    back = files.read_swc(spark, f"file://{tmp_path}/out")
    assert sorted((r.skel, r.node_id, r.parent_id) for r in back.collect()) == sorted((s, n, r[7]) for s, nodes in new.items() for n, r in nodes.items())


def test_points_at_whole_steps(spark):
    """A straight line: points that are there already are not doubled, and the end is not crowded."""
    rows = [("line", k, 0, 2.5 * (k - 1), 0.0, 0.0, 1.0, k - 1 if k > 1 else -1) for k in range(1, 10)]
    got = sorted((r.x, r.node_id, r.parent_id) for r in paths.resampled(spark.createDataFrame(rows, SCHEMA), 5.0).collect())
    assert got == [(0.0, 1, -1), (5.0, 10, 1), (10.0, 11, 10), (15.0, 12, 11), (20.0, 9, 12)]


def test_deep_chain(spark):
    """Rounds follow the logarithm of the depth."""
    rows = [("deep", k, 0, float(k), 0.0, 0.0, 1.0, k - 1 if k > 1 else -1) for k in range(1, 3001)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert paths.spine(table).count() == 3000 and paths.resampled(table, 100.0).count() == 31
