"""Iterative kernels in numpy, one group at a time: coverage, matching, peeling, pruning, tangents.

Each group is one target with one fragment or one skeleton, so groups are as
many as there are pairs, and none grows with the number of volumes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kdtree import Tree

XYZ = ["x", "y", "z"]


#: Distances that are held at once, and pairs of points from which on a tree finds the nearest sooner.
BLOCK, LARGE = 1 << 21, 1 << 21
#: Points of queries that a task scores.
PIECE = 8192


def distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs; callers hand over blocks of ``a``."""
    out = (a[:, None, 0] - b[None, :, 0]) ** 2
    for c in range(1, a.shape[1]):
        out += (a[:, None, c] - b[None, :, c]) ** 2
    return out


def blocks(a: np.ndarray, b: np.ndarray):
    """(first row, distances of a block of rows to all of b)."""
    step = max(1, BLOCK // max(1, len(b)))
    for k in range(0, len(a), step):
        yield k, distances2(a[k : k + step], b)


def near_pairs(em: np.ndarray, frag: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target point, fragment point, squared distance) within the radius, sorted by target point, then from near to far."""
    found = []
    for k, d2 in blocks(em, frag):
        e, f = np.nonzero(d2 <= radius * radius)
        found.append((e + k, f, d2[e, f]))
    e, f, d2 = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((f, d2, e))
    return e[order], f[order], d2[order]


def nearest_pairs(em: np.ndarray, frag: np.ndarray, radius: float, near: int, by_fragment: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the near pairs those in which the target point is among the ``near`` nearest of its fragment point (``by_fragment``), or the
    fragment point among those of its target point, in the order of ``near_pairs``. Large groups ask a tree: only these pairs are held."""
    if len(em) * len(frag) <= LARGE:
        e, f, d2 = near_pairs(em, frag, radius)
        able = (place_within(f, d2, e) if by_fragment else place_within(e, d2, f)) < near
        return e[able], f[able], d2[able]
    some, other = (frag, em) if by_fragment else (em, frag)
    found, d2 = Tree(other).k_nearest(some, min(near, len(other)), radius)
    row, place = np.nonzero((found >= 0) & (found < len(other)))
    e, f = (found[row, place], row) if by_fragment else (row, found[row, place])
    d2 = d2[row, place]
    order = np.lexsort((f, d2, e))
    return e[order], f[order], d2[order]


def place_within(*keys: np.ndarray) -> np.ndarray:
    """The place of each row among those of its first key, in the order of the others."""
    order = np.lexsort(keys[::-1])
    first = keys[0][order]
    starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return out


# ---- coverage ----------------------------------------------------------------


def nearest_inside(points: np.ndarray, of: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of the other points that is nearer than the radius, of equally near ones the first;
    -1 where there is none. Small sides meet in blocks, large ones ask a tree: memory is linear in both."""
    found, d2 = np.full(len(points), -1, np.int64), np.full(len(points), np.inf)
    if not len(of):
        return found, d2
    if len(points) * len(of) > LARGE:
        found, d2 = Tree(of).nearest(points, radius)
        return np.where(found < len(of), found, -1), d2
    for k, some in blocks(points, of):
        found[k : k + len(some)], d2[k : k + len(some)] = some.argmin(axis=1), some.min(axis=1)
    found[~(d2 < radius * radius)] = -1
    return found, d2


def greedy_cover(em: np.ndarray, frag: np.ndarray, radius: float, cap: int = 6, step: float = 1.0) -> np.ndarray:
    """Indices of target points that a fragment covers, each of its points at most ``cap`` in a round.

    A point that is nearest to too many target points keeps its nearest ones and
    leaves; those it gave up and those it kept look for another point in the
    next round, until a round covers nothing new. Of the near pairs only each
    target point's nearest one is held: the next is looked for when its point leaves.
    """
    left, covered = ~np.isfinite(frag).all(axis=1), np.zeros(len(em), bool)  # what has no place is near to nothing
    at, near, todo = np.full(len(em), -1, np.int64), np.full(len(em), np.inf), np.arange(len(em))
    for _ in range(int(radius / step + 1)):
        there = np.flatnonzero(~left)
        found, near[todo] = nearest_inside(em[todo], frag[there], radius)
        at[todo] = np.append(there, -1)[found]
        mine = np.flatnonzero(at >= 0)
        owner = at[mine]
        full = np.bincount(owner, minlength=len(frag)) > cap
        crowd = full[owner]
        kept = ~crowd
        kept[crowd] = place_within(owner[crowd], near[mine][crowd], mine[crowd]) < cap
        now = mine[kept]
        if covered[now].all():
            break
        covered[now] = True
        if not crowd.any():
            break
        left |= full
        todo = mine[crowd]
    return np.flatnonzero(covered)


def optimal_cover(em: np.ndarray, frag: np.ndarray, radius: float, cap: int = 6, *, squared: bool, near: int, by_fragment: bool) -> np.ndarray:
    """The same under an optimal assignment: each target point goes to one fragment point at most, each of these takes
    ``cap`` at most, and the sum of (distance - radius) is least.

    Target points enter one after the other along a cheapest augmenting path, which keeps the assignment optimal. Prices of
    both sides keep every reduced cost from falling below 0, so a path is looked for from near to far and the search
    ends at the first fragment point with room, mostly at once; to stay without a partner costs 0 and has room always.
    ``near``: how many nearest partners are candidates, of each fragment point or of each target point.
    """
    e, f, d2 = nearest_pairs(em, frag, radius, near, by_fragment)
    none = len(frag)  # the place of those without a partner
    partners: list[list[tuple[int, float]]] = [[(none, 0.0)] for _ in range(len(em))]
    for a, b, c in zip(e.tolist(), f.tolist(), (d2 - radius * radius if squared else np.sqrt(d2) - radius).tolist(), strict=True):
        if c < -1e-12:
            partners[a].append((b, c))
    room = [cap] * none + [len(em) + 1]
    choice, takers = [none] * len(em), [set() for _ in range(none + 1)]
    price, own = [0.0] * (none + 1), [0.0] * len(em)  # of fragment points, and of target points
    for start in range(len(em)):
        if len(partners[start]) == 1:
            continue
        own[start] = min(c - price[b] for b, c in partners[start])
        best, via, settled, queue = {}, {}, {}, []

        def reach(x: int, so_far: float) -> None:
            base = so_far - own[x]
            for b, c in partners[x]:
                new = base + c - price[b]
                if b not in settled and new < best.get(b, np.inf):
                    best[b], via[b] = new, x
                    heapq.heappush(queue, (new, -b))  # of equal ways the one without a partner

        reach(start, 0.0)
        while True:
            c, b = heapq.heappop(queue)
            b = -b
            if b in settled or c > best[b]:
                continue
            settled[b] = c
            if room[b]:
                break
            for x in sorted(takers[b]):
                reach(x, c)
        end = c
        own[start] += end
        for k, at in settled.items():
            if k != b:
                price[k] += at - end
                for x in takers[k]:
                    own[x] += end - at
        room[b] -= 1
        while True:  # back along the path: each gives up its place to the one before
            x = via[b]
            left = choice[x]
            if x != start:
                takers[left].discard(x)
            choice[x] = b
            if b != none:
                takers[b].add(x)
            if x == start:
                break
            b = left
    return np.flatnonzero(np.array(choice, np.int64) != none)


def cover(em: np.ndarray, frag: np.ndarray, radius: float, *, version: str = "", cap: int = 6, step: float = 1.0) -> np.ndarray:
    """Coverage by the named version; the mixed ones solve large fragments only."""
    exact = {"ilp_v1": (True, 25, False), "ilp_v2": (False, 15, True), "ilp_v3": (False, 50, True)}
    if version in ("mixed_v1", "mixed_v2"):
        large = len(frag) > (250 if version == "mixed_v1" else 150)
        version = ("ilp_v1" if version == "mixed_v1" else "ilp_v2") if large else ""
    if not version:
        return greedy_cover(em, frag, radius, cap, step)
    if version not in exact:
        raise ValueError(f"no coverage version {version!r}")
    squared, near, by_fragment = exact[version]
    return optimal_cover(em, frag, radius, cap, squared=squared, near=near, by_fragment=by_fragment)


def coverage(em_points: DataFrame, frag_points: DataFrame, radius: float, *, keys: tuple[str, ...] = ("lm_vol", "frag_id"), version: str = "", cap: int = 6, step: float = 1.0, pairs: DataFrame | None = None) -> DataFrame:
    """(em_id, keys, em_pt) of covered points: one group for each target and fragment that are near at all, and among ``pairs``
    (em_id, keys) if these are given.

    Which points are near is told by cells, as wide as the radius: a target's different cells, with those around them, meet a
    fragment's different cells, and each side's points follow their cells. So what is joined are cells, not pairs of points,
    and a group holds the points of either side whose cells touch.
    """
    from .joins import around, cells

    types, group, cell = dict(em_points.dtypes) | dict(frag_points.dtypes), ["em_id", *keys], ["c0", "c1", "c2"]
    placed = lambda df, *ids: df.select(*ids, *XYZ, *[c.alias(n) for c, n in zip(cells(radius), cell, strict=True)])
    em, frag = placed(em_points, "em_id", "em_pt"), placed(frag_points, *keys, "fp")
    beside = em.select("em_id", *cell).distinct().withColumn("d", F.explode(around()))  # the targets are the small side
    beside = beside.select("em_id", F.struct(*cell).alias("own"), *[(F.col(c) + F.col(f"d.d{k}")).alias(c) for k, c in enumerate(cell)])
    touching = beside.join(frag.select(*keys, *cell).distinct(), cell)
    if pairs is not None:
        touching = touching.join(pairs.select(*group).distinct(), group, "left_semi")
    tasks = 20 * em_points.sparkSession.sparkContext.defaultParallelism  # by groups, not by bytes: a group's points are few, its work is not
    pack = lambda df, name, point: df.repartition(tasks, *group).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(point, *XYZ))).alias(name))
    em_side = em.join(touching.select(*group, "own.*").distinct(), ["em_id", *cell])
    frag_side = frag.join(touching.select(*group, *cell).distinct(), [*keys, *cell])
    packed = pack(em_side, "em", "em_pt").join(pack(frag_side, "frag", "fp"), group)

    def sides(column: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        name, *xyz = column.values.flatten()
        return column.offsets.to_numpy(), name, np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in xyz])

    def run(batches):
        for batch in batches:
            (e_at, name, e), (f_at, _, f) = (sides(batch.column(side)) for side in ("em", "frag"))
            # the group holds what is near: a round number that depends on all points stays the same
            found = [e_at[k] + cover(e[e_at[k] : e_at[k + 1]], f[f_at[k] : f_at[k + 1]], radius, version=version, cap=cap, step=step) for k in range(batch.num_rows)]
            which = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            points = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.record_batch([*(batch.column(c).take(which) for c in group), name.take(points)], names=[*group, "em_pt"])

    return packed.select(*group, "em", "frag").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in [*group, "em_pt"]))


# ---- skeletons ---------------------------------------------------------------


def peeled_weights(parents: np.ndarray, power: float = 1.0, chop: int = 50, last: int = 5) -> np.ndarray:
    """A weight for each node of a skeleton in depth-first file order (parents 1-based, -1 for roots).

    Segments run in file order from a root or a branch's child to the next such
    node. While there are more than ``last``, the shortest segment that ends in a
    tip is peeled off and its points weigh its length; what is left in the end
    shares one weight, but for the ends of its segments.

    Segments stand in a linked list, those with tips in a heap. Peeling one takes a child from its branch; a branch with
    one child left is none any more, and that child's segment goes on the one before it. So n nodes with s segments
    take n + s log s steps.
    """
    n = len(parents)
    parent, weight, peeled = np.where(parents == -1, -1, parents - 1), np.zeros(n), 1.0
    if not n:
        return weight
    count, children = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # by parent, -1 last: how many, and the sum of their numbers
    np.add.at(count, parent, 1)
    np.add.at(children, parent, np.arange(n))
    first = np.flatnonzero((count[parent] > 1) | (parent == -1))
    stop = np.append(first[1:], n) - 1
    segments, starts = len(first), first.tolist()
    ends, size = stop.tolist(), (stop - first + 1).tolist()
    tip = (count[stop] <= 1).tolist()
    before, after = list(range(-1, segments - 1)), [*range(1, segments), -1]
    pieces, tail = [-1] * segments, list(range(segments))  # a segment's pieces of the file: the next one, and its last
    at_start, at_end = {a: k for k, a in enumerate(starts)}, {b: k for k, b in enumerate(ends)}
    there, left, head = [True] * segments, segments, 0
    loose = np.zeros(n, bool)  # of no segment: before the first start
    loose[: starts[0] if starts else n] = True
    gone = np.zeros(n, bool)
    heap = [(size[k] + 1, starts[k], k) for k in range(segments) if tip[k]]
    heapq.heapify(heap)

    def held(k: int):
        while k >= 0:
            yield slice(int(first[k]), int(stop[k]) + 1)
            k = pieces[k]

    def unlink(k: int) -> None:
        nonlocal left, head
        there[k], left = False, left - 1
        if before[k] >= 0:
            after[before[k]] = after[k]
        else:
            head = after[k]
        if after[k] >= 0:
            before[after[k]] = before[k]

    while left > last:
        while heap and not (there[heap[0][2]] and tip[heap[0][2]] and size[heap[0][2]] + 1 == heap[0][0]):
            heapq.heappop(heap)
        if not heap:  # no segment ends in a tip: the file is in another order
            rest = np.flatnonzero(~gone)
            return _peeled_by_rounds(rest, parent[rest], weight, peeled, power, chop, last)
        length, start, k = heapq.heappop(heap)
        peeled = float(length) ** power
        for part in held(k):
            weight[part], gone[part] = peeled, True
        unlink(k)
        p = int(parent[start])
        count[p] -= 1
        children[p] -= start
        if p < 0 or count[p] != 1:
            continue
        joins = at_start[int(children[p])]
        onto = before[joins]
        unlink(joins)
        if onto >= 0:
            pieces[tail[onto]], tail[onto] = joins, tail[joins]
            size[onto] += size[joins]
            ends[onto], tip[onto] = ends[joins], tip[joins]
            at_end[ends[onto]] = onto
        else:
            for part in held(joins):
                loose[part] = True
        ending = at_end.get(p, -1)
        if ending >= 0 and there[ending] and ends[ending] == p:
            tip[ending] = True
        for m in {onto, ending}:
            if m >= 0 and there[m] and tip[m]:
                heapq.heappush(heap, (size[m] + 1, starts[m], m))
    rest, k, lengths, stops = ~gone, head, [], []
    while k >= 0:
        lengths.append(size[k] + 1)
        stops.append(ends[k])
        k = after[k]
    _share_the_rest(weight, np.flatnonzero(rest), stops, np.array(lengths, np.int64), peeled, power, chop)
    return weight


def _share_the_rest(weight: np.ndarray, ids: np.ndarray, stops: list[int], lengths: np.ndarray, peeled: float, power: float, chop: int) -> None:
    ends = np.minimum(lengths, chop)
    weight[ids] = max(peeled, max(0.0, (len(ids) - ends.sum()) / max(1, len(lengths))) ** power)
    for stop, n in zip(stops, ends.tolist(), strict=True):
        window = np.arange(stop - n, stop + 1)  # numbers of the whole skeleton: may reach beyond the segment
        weight[window[window >= 0] if stop - n >= 0 else window] = n**power


def _peeled_by_rounds(ids: np.ndarray, parent: np.ndarray, weight: np.ndarray, peeled: float, power: float, chop: int, last: int) -> np.ndarray:
    """The same, looking at all nodes for each segment: for files in which some round finds no tip."""
    while len(ids):
        values, counts = np.unique(parent, return_counts=True)
        branches = set(values[counts > 1].tolist())
        starts = np.flatnonzero(np.isin(parent, list(branches)) | (parent == -1))
        stops = np.append(starts[1:], len(ids)) - 1
        lengths = stops - starts + 2
        if len(starts) <= last:
            _share_the_rest(weight, ids, ids[stops].tolist(), lengths, peeled, power, chop)
            break
        tip = np.array([ids[s] not in branches for s in stops])
        k = int(np.argmin(np.where(tip, lengths, 2 * lengths.max())))
        start, stop = int(starts[k]), int(stops[k])
        length = lengths[k] if tip[k] else 2 * lengths.max()
        if parent[start] == -1 and ids[stop] in branches:  # without its root, the first branch goes on as its own
            children = np.flatnonzero(parent == ids[stop])
            fresh = parent.max() + 1 + np.arange(len(children))
            parent[children] = fresh
        peeled = float(length) ** power
        weight[ids[start : stop + 1]] = peeled
        keep = np.r_[0:start, stop + 1 : len(ids)]
        ids, parent = ids[keep], parent[keep]
    return weight


def neighbours_of(ids: list[int], parents: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {n: [] for n in ids}
    for n, p in zip(ids, parents, strict=True):
        if p in out and p != n:
            out[n].append(p)
            out[p].append(n)
    return out


def pruned(ids: list[int], parents: list[int], xyz: np.ndarray, length: float, rounds: int = 1) -> set[int]:
    """Nodes left after removing, in each round, every tip branch not longer than ``length`` (the edge into its branch node included)."""
    at = {n: xyz[k] for k, n in enumerate(ids)}
    graph = neighbours_of(ids, parents)
    for _ in range(rounds):
        gone: set[int] = set()
        for tip in [n for n, ns in graph.items() if len(ns) == 1]:
            path, total, here = [tip], 0.0, graph[tip][0]
            total += float(np.linalg.norm(at[tip] - at[here]))
            while len(graph[here]) == 2:
                path.append(here)
                ahead = [n for n in graph[here] if n not in path[-2:]]
                if not ahead:
                    break
                total += float(np.linalg.norm(at[here] - at[ahead[0]]))
                here = ahead[0]
            if len(graph[here]) <= 1 and here not in path:
                path.append(here)
            if total <= length:
                gone |= set(path)
        graph = {n: [m for m in ns if m not in gone] for n, ns in graph.items() if n not in gone}
    return set(graph)


def depth_first(ids: list[int], parents: list[int]) -> list[tuple[int, int, int]]:
    """(node, new id, new parent) of all components: each from its first tip on, depth first, numbered from 1."""
    graph, seen, out = neighbours_of(ids, parents), set(), []
    for first in sorted(graph):
        if first in seen:
            continue
        part, todo = {first}, [first]
        while todo:
            todo += [m for m in graph[todo.pop()] if m not in part and not part.add(m)]
        start = min((n for n in part if len(graph[n]) == 1), default=min(part))
        stack = [(start, -1)]
        while stack:
            node, parent = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((node, len(out) + 1, parent))
            stack += [(m, len(out)) for m in sorted(graph[node], reverse=True) if m not in seen]
    return out


def nearest_of_own(xyz: np.ndarray, k: int):
    """(first row, the k nearest points of a block of rows): all distances of a small skeleton, a tree of a large one."""
    if len(xyz) * len(xyz) <= LARGE:
        for a, d2 in blocks(xyz, xyz):
            yield a, np.argpartition(d2, k - 1, axis=1)[:, :k]
        return
    tree = Tree(xyz)
    for a in range(0, len(xyz), 1 << 14):
        yield a, tree.k_nearest(xyz[a : a + (1 << 14)], k)[0]


def tangents(xyz: np.ndarray, k: int = 5) -> np.ndarray:
    """Unit direction at each point: the main axis of its k nearest points, itself included."""
    out, k = np.zeros_like(xyz), min(k, len(xyz))
    for a, near in nearest_of_own(xyz, k):
        local = xyz[near] - xyz[near].mean(axis=1, keepdims=True)
        _, vectors = np.linalg.eigh(local.transpose(0, 2, 1) @ local)
        axis = vectors[:, :, 2]
        sign = np.sign(axis[np.arange(len(axis)), np.abs(axis).argmax(axis=1)])
        out[a : a + len(near)] = axis * sign[:, None]
    return out


def point_scores(query: np.ndarray, target: np.ndarray, table: np.ndarray, distances: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """The table's score of each of the query's points (x, y, z, tangent) for the distance to the nearest target point and the angle between tangents."""
    if len(query) * len(target) > LARGE:
        near, d2 = Tree(target[:, :3]).nearest(query[:, :3])
    else:
        near, d2 = np.zeros(len(query), np.int64), np.zeros(len(query))
        for k, some in blocks(query[:, :3], target[:, :3]):
            near[k : k + len(some)], d2[k : k + len(some)] = some.argmin(axis=1), some.min(axis=1)
    dot = np.abs((query[:, 3:] * target[near, 3:]).sum(axis=1))
    row = np.clip(np.searchsorted(distances, np.sqrt(d2), "right") - 1, 0, len(table) - 1)
    column = np.clip(np.searchsorted(angles, dot, "right") - 1, 0, table.shape[1] - 1)
    return table[row, column]


def pair_score(query: np.ndarray, target: np.ndarray, table: np.ndarray, distances: np.ndarray, angles: np.ndarray) -> float:
    """Mean of the points' scores."""
    return float(point_scores(query, target, table, distances, angles).mean())


def per_skeleton(nodes: DataFrame, kernel, schema: str, group: str = "skel_id") -> DataFrame:
    """A kernel on each skeleton's nodes, in order of node_id."""
    return nodes.groupBy(group).applyInPandas(lambda pdf: kernel(pdf.sort_values("node_id", kind="stable").reset_index(drop=True)), schema)


def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
    w = peeled_weights(pdf["parent_id"].to_numpy(np.int64).copy())
    return pd.DataFrame({"skel_id": pdf["skel_id"], "node_id": pdf["node_id"], "weight": w * len(w) / max(w.sum(), 1e-300)})


def prune(length: float, rounds: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pruned(pdf["node_id"].tolist(), pdf["parent_id"].tolist(), pdf[XYZ].to_numpy(float), length, rounds)
        return pdf.loc[pdf["node_id"].isin(left), ["skel_id", "node_id"]]

    return run


def relabel(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = depth_first(pdf["node_id"].tolist(), pdf["parent_id"].tolist())
    return pd.DataFrame([(pdf["skel_id"].iloc[0], *r) for r in rows], columns=["skel_id", "node_id", "new_id", "new_parent"])


def dotprops(k: int, group: str = "skel_id"):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = tangents(pdf[XYZ].to_numpy(float), k)
        return pdf[[group, "node_id", *XYZ]].assign(tx=t[:, 0], ty=t[:, 1], tz=t[:, 2])

    return run


def similarity(queries: DataFrame, targets: DataFrame, table: np.ndarray, distances: np.ndarray, angles: np.ndarray, block: int = 200_000, ids: str = "long") -> DataFrame:
    """(query, target, score) of every query against every target, both (skel_id, x ... tz).

    Targets are dealt to blocks of about ``block`` points, whole, and queries point by point to smaller ones, since a score is a
    mean over the query's points; each pair of blocks is a group of its own, so that no task holds more than two blocks, one
    large query is shared by many tasks, and nothing passes the driver.
    """
    cols = [*XYZ, "tx", "ty", "tz"]
    count = lambda df, size: max(1, -(-df.count() // size))
    n, m = count(queries, min(block, PIECE)), count(targets, block)
    tasks = max(1, min(n * m, 20 * queries.sparkSession.sparkContext.defaultParallelism + n * m // 8))
    number = lambda size, *keys: F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    a = queries.select("skel_id", *cols, number(n, "skel_id", *XYZ).alias("qb")).withColumn("tb", every(m)).repartition(tasks, "qb", "tb")
    # columns of its own on each side: both may come from one table
    b = targets.select(F.col("skel_id").alias("t_id"), *[F.col(c).alias(f"t_{c}") for c in cols], number(m, "skel_id").alias("t_block")).withColumn("q_block", every(n)).repartition(tasks, "q_block", "t_block")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, places, rows = left[cols].to_numpy(float), left.groupby("skel_id").indices, []
        for t, p in right.groupby("t_id"):  # all queries' points at once: a large target's tree is built once
            scores = point_scores(x, p[[f"t_{c}" for c in cols]].to_numpy(float), table, distances, angles)
            rows += [(q, t, len(at) * float(scores[at].mean()), len(at)) for q, at in places.items()]
        return pd.DataFrame(rows, columns=["query", "target", "total", "points"])

    parts = a.groupBy("qb", "tb").cogroup(b.groupBy("q_block", "t_block")).applyInPandas(run, f"query {ids}, target {ids}, total double, points long")
    return parts.groupBy("query", "target").agg((F.sum("total") / F.sum("points")).alias("score"))


def normalized(scores: DataFrame) -> DataFrame:
    """(query, target, score) divided by what the query scores against itself, which must be among the rows."""
    own = scores.filter("query = target").select("query", F.col("score").alias("own"))
    return scores.join(own, "query").select("query", "target", (F.col("score") / F.col("own")).alias("score"))
