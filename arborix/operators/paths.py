"""Paths of skeletons: spines, segments between forks, and even resampling along them.

A node's pointer begins at its parent and doubles its reach each round, with the
length of what it passes; nodes whose pointer stays (roots, forks, marked nodes)
stop it. So a path of n nodes takes log2(n) rounds, whatever the shape of the
tree, and each round is a join on (skeleton, node) whose result is a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import read_back

XYZ = ("x", "y", "z")


def with_parents(nodes: DataFrame, group: str, values: tuple[str, ...] = XYZ) -> DataFrame:
    """(group, node_id, parent_id, values, p_values, edge): each node with its parent's values and the length of the edge to it; roots have nulls and 0."""
    parents = nodes.select(group, F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in values])
    d2 = sum(((F.col(c) - F.col(f"p_{c}")) * (F.col(c) - F.col(f"p_{c}")) for c in XYZ), F.lit(0.0))
    return nodes.select(group, "node_id", "parent_id", *values).join(parents, [group, "parent_id"], "left").withColumn("edge", F.coalesce(F.sqrt(d2), F.lit(0.0)))


def doubled(pointers: DataFrame, group: str) -> list[DataFrame]:
    """(group, node_id, to, length) -> the same after 1, 2, 4, ... steps, until no pointer moves; the last has every node's end.

    A node whose pointer is itself stops there. Each table is written once.
    """
    tables = [read_back(pointers.select(group, "node_id", "to", "length"), "pointers")]
    while True:
        here = tables[-1]
        ahead = here.select(group, F.col("node_id").alias("to"), F.col("to").alias("far"), F.col("length").alias("more"))
        moved = here.join(ahead, [group, "to"]).select(group, "node_id", F.col("far").alias("to"), (F.col("length") + F.col("more")).alias("length"), (F.col("far") != F.col("to")).alias("moved"))
        table = read_back(moved, "pointers")
        if table.filter("moved").isEmpty():
            return tables
        tables.append(table.drop("moved"))


def ancestors(marked: DataFrame, tables: list[DataFrame], group: str) -> DataFrame:
    """(group, node_id): the marked nodes and all that their pointers pass, from the farthest reach to the nearest."""
    for table in reversed(tables):
        passed = marked.join(table, [group, "node_id"]).select(group, F.col("to").alias("node_id"))
        marked = read_back(marked.unionByName(passed).distinct(), "marked")
    return marked


def _farthest(lengths: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """(keys, node_id, length) of the farthest node; of equals (to nine digits behind the point) the least."""
    best = F.max(F.struct(F.round(length, 9).alias("r"), (-F.col("node_id")).alias("n"), F.col(length).alias("l"))).alias("m")
    return lengths.groupBy(*keys).agg(best).select(*keys, (-F.col("m.n")).alias("node_id"), F.col("m.l").alias("length"))


def spine(nodes: DataFrame, group: str = "skel_id") -> DataFrame:
    """(group, node_id, parent_id, at, and the other columns of nodes): the longest path between any two nodes of a skeleton,
    as a skeleton of its own. It begins at the end with the lesser number; ``at`` is the length up to a node.

    The farthest node from a root is one end (A). Its way to the root is marked; every other node's farthest distance from A
    is known from where its own way meets the marked one, and the farthest is the other end (B). Of several trees of a
    skeleton the longest path counts, of equals the one whose root has the least number. A tree of one node is its own spine.
    """
    joined = with_parents(nodes, group)
    up = joined.select(group, "node_id", F.when(F.col("parent_id") == -1, F.col("node_id")).otherwise(F.col("parent_id")).alias("to"), F.col("edge").alias("length"))
    to_root = doubled(up, group)
    depth = to_root[-1].select(group, "node_id", F.col("to").alias("root"), F.col("length").alias("depth"))
    a = read_back(_farthest(depth.withColumnRenamed("depth", "length"), [group, "root"]), "ends")
    marked = ancestors(a.select(group, "node_id"), to_root, group)
    # the same again, up to the marked way
    stop = up.join(marked.withColumn("on", F.lit(True)), [group, "node_id"], "left")
    to_way = doubled(stop.select(group, "node_id", F.when(F.col("on"), F.col("node_id")).otherwise(F.col("to")).alias("to"), F.when(F.col("on"), F.lit(0.0)).otherwise(F.col("length")).alias("length")), group)
    meets = to_way[-1].select(group, "node_id", F.col("to").alias("meets"), F.col("length").alias("off"))
    at_meeting = depth.select(group, F.col("node_id").alias("meets"), F.col("root"), F.col("depth").alias("meeting_depth"))
    from_a = meets.join(at_meeting, [group, "meets"]).join(a.select(group, "root", F.col("node_id").alias("a"), F.col("length").alias("a_depth")), [group, "root"])
    from_a = read_back(from_a.withColumn("length", F.col("a_depth") - F.col("meeting_depth") + F.col("off")), "from_a")
    b = _farthest(from_a, [group, "root"])
    longest = b.groupBy(group).agg(F.max(F.struct(F.round("length", 9).alias("r"), (-F.col("root")).alias("n"))).alias("m")).select(group, (-F.col("m.n")).alias("root"))
    b = read_back(b.join(longest, [group, "root"]).select(group, "root", F.col("node_id").alias("b"), F.col("length").alias("whole")), "ends")
    met = b.join(from_a.select(group, F.col("node_id").alias("b"), "a", "meets"), [group, "b"]).join(depth.select(group, F.col("node_id").alias("meets"), F.col("depth").alias("top")), [group, "meets"])
    met = read_back(met.select(group, "a", "b", "meets", "top", "whole"), "ends")
    # A's part: marked nodes not above the meeting; B's part: what B passes up to it
    a_part = marked.join(depth, [group, "node_id"]).join(met, group).join(a.select(group, F.col("node_id").alias("a")), [group, "a"]).filter(F.col("depth") >= F.col("top"))
    a_part = a_part.join(from_a.select(group, "node_id", F.col("a").alias("own")), [group, "node_id"]).filter(F.col("own") == F.col("a"))
    b_part = ancestors(met.filter(F.col("b") != F.col("meets")).select(group, F.col("b").alias("node_id")), to_way, group)
    place = from_a.select(group, "node_id", "length")
    part = lambda df, side: df.select(group, "node_id").withColumn("side", F.lit(side))
    on_way = part(a_part, "a").unionByName(part(b_part.join(marked, [group, "node_id"], "left_anti"), "b")).join(place, [group, "node_id"]).join(met, group)
    # every node but the meeting has an edge to its parent, and the path runs along it up or down
    edges = on_way.filter(F.col("node_id") != F.col("meets")).join(nodes.select(group, "node_id", F.col("parent_id").alias("up")), [group, "node_id"])
    forward = F.col("a") < F.col("b")  # from A to B
    down = (F.col("side") == "a") == forward  # then the path comes from the node to its parent
    links = edges.select(group, F.when(down, F.col("up")).otherwise(F.col("node_id")).alias("node_id"), F.when(down, F.col("node_id")).otherwise(F.col("up")).alias("parent_id"))
    first = met.select(group, F.least("a", "b").alias("node_id"), F.lit(-1).alias("parent_id"))
    at = on_way.select(group, "node_id", F.when(forward, F.col("length")).otherwise(F.col("whole") - F.col("length")).alias("at"))
    others = [c for c in nodes.columns if c not in (group, "node_id", "parent_id")]
    whole = links.unionByName(first.select(*links.columns)).join(at, [group, "node_id"]).join(nodes.select(group, "node_id", *others), [group, "node_id"])
    return whole.select(group, "node_id", F.col("parent_id").cast(dict(nodes.dtypes)["parent_id"]).alias("parent_id"), "at", *others)


def segments(nodes: DataFrame, group: str = "skel_id", values: tuple[str, ...] = XYZ) -> DataFrame:
    """Each edge with the segment it lies on: (group, top, upper, node_id, parent_id, values, p_values, at, edge, key, total).

    A segment runs from a root or fork (``upper``) down to the next fork or tip; ``top`` is its first node below. ``at`` is the
    length from the upper end to a node, ``total`` that of the segment, ``key`` whether the node is its lower end.
    """
    joined = with_parents(nodes, group, values)
    children = nodes.filter("parent_id <> -1").groupBy(group, F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    known = read_back(joined.join(children, [group, "node_id"], "left").withColumn("key", (F.col("parent_id") == -1) | (F.coalesce("children", F.lit(0)) != 1)).drop("children"), "edges")
    keys = known.select(group, F.col("node_id").alias("parent_id"), F.col("key").alias("below_key"))
    edges = known.filter("parent_id <> -1").join(keys, [group, "parent_id"])
    pointers = edges.select(group, "node_id", F.when(F.col("below_key"), F.col("node_id")).otherwise(F.col("parent_id")).alias("to"), F.when(F.col("below_key"), F.lit(0.0)).otherwise(F.col("edge")).alias("length"))
    tops = doubled(pointers, group)[-1].select(group, "node_id", F.col("to").alias("top"), F.col("length").alias("past_top"))
    first = known.select(group, F.col("node_id").alias("top"), F.col("parent_id").alias("upper"), F.col("edge").alias("first_edge"))
    placed = read_back(known.join(tops, [group, "node_id"]).join(first, [group, "top"]).withColumn("at", F.col("first_edge") + F.col("past_top")), "placed")
    total = placed.filter("key").select(group, "top", F.col("at").alias("total"))
    return placed.join(total, [group, "top"]).drop("first_edge", "past_top")


def resampled(nodes: DataFrame, step: float, group: str = "skel_id", values: tuple[str, ...] = XYZ) -> DataFrame:
    """(group, node_id, parent_id, values) of skeletons with even points: every ``step`` along a segment from its upper end,
    whatever edges it has, a node; roots, forks and tips stay, with their numbers; segments not longer than ``step`` stay as
    they are. New nodes are numbered on from the skeleton's greatest number. ``values`` (x, y, z and what else, such as a radius) are interpolated.
    """
    step = float(step)
    pieces = segments(nodes, group, values)
    long = F.col("total") > step
    # how many steps end before a length, and how many up to it
    before = lambda length: F.greatest(F.ceil(length / F.lit(step) - F.lit(1e-9)).cast("long") - 1, F.lit(0))
    upto = lambda length: F.floor(length / F.lit(step) + F.lit(1e-9)).cast("long")
    ends = pieces.filter("key").select(group, "top", "upper", F.col("node_id").alias("lower"), F.when(long, before(F.col("total"))).otherwise(F.lit(0)).alias("n"))
    greatest = nodes.groupBy(group).agg(F.max("node_id").cast("long").alias("greatest"))
    order = Window.partitionBy(group).orderBy("top").rowsBetween(Window.unboundedPreceding, -1)  # a row for each segment
    numbered = ends.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).join(greatest, group).withColumn("base", F.col("base") + F.col("greatest")).drop("greatest")
    numbered = read_back(numbered, "segments")
    # new nodes k with at(parent) < k * step <= at(node), and k * step < total
    k0, k1 = upto(F.col("at") - F.col("edge")), F.least(upto(F.col("at")), F.col("n"))
    on_edges = pieces.filter(long).join(numbered.select(group, "top", "n", "base"), [group, "top"]).withColumns({"k0": k0, "k1": k1}).filter("k1 > k0")
    new = on_edges.withColumn("k", F.explode(F.sequence(F.col("k0") + 1, F.col("k1"))))
    share = F.when(F.col("edge") > 0, (F.col("k") * F.lit(step) - (F.col("at") - F.col("edge"))) / F.col("edge")).otherwise(F.lit(0.0))
    between: list[Column] = [(F.col(f"p_{c}") + (F.col(c) - F.col(f"p_{c}")) * F.col("share")).alias(c) for c in values]
    above = F.when(F.col("k") == 1, F.col("upper").cast("long")).otherwise(F.col("base") + F.col("k") - 1)
    points = new.withColumn("share", share).select(group, (F.col("base") + F.col("k")).alias("node_id"), above.alias("parent_id"), *between)
    # lower ends hang on the last new node; nodes of short segments, and roots, stay
    kept = pieces.filter(F.col("key") | ~long).join(numbered.select(group, "top", "n", "base"), [group, "top"])
    kept = kept.select(group, F.col("node_id").cast("long").alias("node_id"), F.when(~long, F.col("parent_id").cast("long")).when(F.col("n") > 0, F.col("base") + F.col("n")).otherwise(F.col("upper").cast("long")).alias("parent_id"), *values)
    roots = nodes.filter("parent_id = -1").select(group, F.col("node_id").cast("long").alias("node_id"), F.lit(-1).cast("long").alias("parent_id"), *values)
    return points.unionByName(kept).unionByName(roots)
