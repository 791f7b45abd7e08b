"""SimHash near-duplicates by pivot distance tables.

Each text gets a 64-bit fingerprint: a bit is set if it is set in over half of
the hashes of the text's word shingles. Copies share a fingerprint, so all that
follows works on different fingerprints only.

References ("pivots") are the zero word, the masks of disjoint blocks of bits,
and a number of random words. The distances to the first two kinds are the
coordinates that place a fingerprint: two fingerprints within ``distance`` bits
differ in the coordinates of ``distance`` blocks at most, so with the blocks in
``groups`` groups they agree on all coordinates of at least
``groups - distance`` groups. Every choice of that many groups is a join key;
``plan`` takes as many groups and as narrow blocks as the number of
fingerprints needs for keys of a few members. Members of a key whose distances
to any random pivot differ by more than ``distance`` are discarded (triangle
inequality), and survivors are verified by counting bits. Only a spanning
forest of the links of a key is emitted.

A key with over ``crowd`` members is never paired up: fingerprints within two
bits have a common neighbour within one bit, so each member is filed under its
65 such neighbours, each of which can have at most 65 fingerprints. That way is
exact as well and its work is linear.

Defined cases: null and empty texts, and texts of blanks, have fingerprint
zero; texts with fewer words than a shingle have one shingle; repeated rows get
equal results, and one of them stays in ``keep_one``; rows without doc_id are
kept after those with one; an empty table gives an empty result; all columns of
the documents pass, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Random references, the same on every machine.
PIVOTS = np.random.default_rng(SEED).integers(0, 1 << 64, 16, dtype=np.uint64)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash over shingles of ``size`` words."""
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= size:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
        starts = np.concatenate([[0], ends[:-size]])
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, counted in blocks of bounded size."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist())


def with_fingerprint(documents: DataFrame, *, text: str = "text", size: int = 3, into: str = "fp") -> DataFrame:

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(common.signed(np.array([fingerprint(t, size) for t in common.utf8(texts)], np.uint64)))

    return documents.withColumn(into, common.arrow_udf("near", run, "long")(F.col(f"`{text}`")))


def plan(count: int, distance: int) -> tuple[int, int]:
    """(bits in a block, groups): the fewest keys that leave few members to each."""
    need = max(1.0, math.log2(max(2, count))) + 1
    for width, entropy in ((4, 0.507), (2, 0.75), (1, 1.0)):  # what popcounts of blocks of random bits tell, per bit
        for groups in range(distance + 1, 9):
            if 64 * entropy * (groups - distance) / groups >= need and math.comb(groups, distance) <= 10:
                return width, groups
    return 1, 8


def coordinate_keys(fp: Column, distance: int, width: int, groups: int) -> list[Column]:
    """For each choice of groups the hash of their blocks' coordinates."""
    zero = F.bit_count(fp)
    blocks = list(range(0, 64, width))
    masks = [((1 << width) - 1) << b for b in blocks]
    # d(x, 0) and d(x, mask) give the coordinate (d(x, 0) + width - d(x, mask)) / 2
    coordinate = [(zero + width - F.bit_count(fp.bitwiseXOR(F.lit(m - (1 << 64) if m >> 63 else m)))) / 2 for m in masks]
    member = [[c.cast("int") for k, c in enumerate(coordinate) if k % groups == g] for g in range(groups)]
    return [F.xxhash64(F.lit(n), *[c for g in chosen for c in member[g]]) for n, chosen in enumerate(itertools.combinations(range(groups), groups - distance))]


def links_within(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, least member) of the links among fingerprints with equal, adjacent keys."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    at, found_a, found_b = np.arange(len(keys)), [], []
    step = 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        left = at
        for p in range(len(PIVOTS)):  # the difference in any coordinate is at most the distance
            left = left[np.abs(table[left, p] - table[left + step, p]) <= distance]
        left = left[np.bitwise_count(fps[left] ^ fps[left + step]) <= distance]
        found_a.append(left)
        found_b.append(left + step)
        step += 1
    if not found_a:
        return fps[:0], fps[:0]
    a, b, label = np.concatenate(found_a), np.concatenate(found_b), np.arange(len(keys))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return fps[moved], fps[label[moved]]


def pair_up(distance: int, crowd: int):
    """Partitions sorted by key -> rows (crowded, a, b): links, or (neighbour, member) for crowded keys."""

    def out(crowded: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"crowded": pa.array(np.full(len(a), crowded)), "a": common.signed(a), "b": common.signed(b)})

    def neighbours(fps: np.ndarray) -> pa.RecordBatch:
        near = np.concatenate([fps[:, None], fps[:, None] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))[None, :]], axis=1)
        return out(True, near.ravel(), np.repeat(fps, 65))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if over is not None and len(keys):  # the rest of a crowd
                rest = int(np.searchsorted(keys != over, True)) if (keys != over).any() else len(keys)
                for k in range(0, rest, 1000):
                    yield neighbours(fps[k : min(rest, k + 1000)])
                keys, fps = keys[rest:], fps[rest:]
                over = None if len(keys) else over
            if not len(keys):
                continue
            last = len(keys) if batch is None else int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            starts = np.flatnonzero(np.concatenate([[True], keys[1:last] != keys[: last - 1]])) if last else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, last))
            small = np.ones(last, bool)
            for s, n in zip(starts[sizes > crowd].tolist(), sizes[sizes > crowd].tolist(), strict=True):
                small[s : s + n] = False
                for k in range(s, s + n, 1000):
                    yield neighbours(fps[k : min(s + n, k + 1000)])
            yield out(False, *links_within(keys[:last][small], fps[:last][small], distance))
            keys, fps = keys[last:], fps[last:]
            if len(keys) > crowd:
                over = keys[0]
                for k in range(0, len(keys), 1000):
                    yield neighbours(fps[k : k + 1000])
                keys, fps = keys[:0], fps[:0]

    return run


def links(distinct: DataFrame, count: int, *, distance: int = 2, crowd: int = 4096) -> DataFrame:
    """Links (a, b) that join all fingerprints ("fp", distinct) within ``distance`` bits: at most two."""
    if distance > 2:
        raise ValueError("crowded keys are exact up to a distance of 2")
    spark = distinct.sparkSession
    width, groups = plan(count, distance)
    keyed = distinct.select(F.explode(F.array(*coordinate_keys(F.col("fp"), distance, width, groups))).alias("key"), "fp")
    # half the keys have one member: they need no Python
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 200_000)
    found = common.arrow_stream("near", keyed.repartition(parts, "key").sortWithinPartitions("key", "fp"), pair_up(distance, crowd), "crowded boolean, a long, b long")
    return found


def join_crowds(found: DataFrame) -> DataFrame:
    """Links among members filed under the same neighbour: each with the least of them."""
    filed = found.filter("crowded").select("a", "b").distinct()
    least = filed.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).filter("n > 1")
    crowd = filed.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return found.filter("NOT crowded").select("a", "b").unionByName(crowd).filter("a <> b").distinct()


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(node, root) for nodes of undirected edges (a, b), root the least node of the component; single nodes are absent.

    Alternating large-star and small-star rounds until nothing changes; each
    round is an aggregate and a join on the same key, and its result a table.
    """
    state, k, before = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0"), 0, None

    def digest(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        return r[0], r[1]

    now = digest(state)
    while now != before and now[0]:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), f"least{k}")  # tables: joins of two exchanges can split a hub's rows
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = scratch.save(large, f"large{k}")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = scratch.save(down.groupBy("a").agg(F.min("b").alias("m")), f"lower{k}")
        small = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        state = scratch.save(small, f"edges{k}")
        scratch.drop(f"large{k - 1}")
        scratch.drop(f"edges{k - 1}")
        before, now = now, digest(state)
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: Stands for null doc_ids where rows are matched.
NO_ID = -(1 << 63)


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 3, distance: int = 2, shingles: bool = False) -> DataFrame:
    """(doc_id, fp, component_id, keep_id, keep_mark): one row per document. component_id is the least doc_id that
    links reach, null if there is none; keep_id and keep_mark (hash of the text) name the row to keep of each component.
    With ``shingles`` texts are also linked that are near copies by their word shingles."""
    spark = documents.sparkSession
    scratch = common.Scratch(spark, "simhash")
    ids = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = scratch.save(with_fingerprint(ids, size=size).select("doc_id", F.xxhash64("text").alias("mark"), "fp"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "mark"))
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), first.alias("first")), "distinct")
    found = scratch.save(links(distinct.select("fp"), distinct.count(), distance=distance), "found")
    roots = components(join_crowds(found), scratch)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    if shingles:
        rooted = _joined_by_shingles(ids, prints, rooted, scratch)
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(classes, "root").select("fp", "component_id", F.col("first.id").alias("keep_id"), F.col("first.mark").alias("keep_mark"))
    return scratch.keep(prints.join(named, "fp").select("doc_id", "fp", "component_id", "keep_id", "keep_mark"))


def _joined_by_shingles(ids: DataFrame, prints: DataFrame, rooted: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Components of fingerprints, joined further where texts of two of them are near copies."""
    from . import shinglelinks

    with common.Scratch(ids.sparkSession, "shingles") as more:
        root_of = more.save(prints.select("mark", "fp").distinct().join(rooted.select("fp", "root"), "fp").select("mark", "root"), "root_of")
        pairs = more.save(shinglelinks.links(ids.select(F.xxhash64("text").alias("mark"), "text"), more), "pairs")
        a, b = (root_of.select(F.col("mark").alias(c), F.col("root").alias(f"root_{c}")).hint("merge") for c in "ab")
        edges = pairs.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b").distinct()
        further = components(edges, more).select(F.col("node").alias("root"), F.col("root").alias("further"))
        return scratch.save(rooted.join(further, "root", "left").select("fp", "least", "first", F.coalesce("further", "root").alias("root")), "joined")


@common.shielded
def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One row of each group of near-duplicates, by fingerprints and by shingles: that of its least doc_id, of repeated
    doc_ids the least hash, of equal rows any."""
    found = near_duplicates(documents.select("doc_id", "text"), **{"shingles": True} | options)
    kept = found.select(F.col("keep_id").alias("__id"), F.col("keep_mark").alias("__mark")).distinct()
    marked = documents.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__mark": F.xxhash64("text")})
    single = marked.join(kept.hint("merge"), ["__id", "__mark"], "left_semi")  # the same join at every size
    return single.dropDuplicates(["__id", "__mark"]).select(*common.columns(documents))


def op8_simhash(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return near_duplicates(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(documents: list[tuple[int, str | None]], distance: int = 2) -> dict[int, tuple[str, int]]:
    """All pairs and a search of the graph, for tests."""
    prints = [(d, _slow(t)) for d, t in documents]
    label = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for (a, x), (b, y) in itertools.combinations(prints, 2):
            if (x ^ y).bit_count() <= distance and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {d: (f"{x:016x}", label[d]) for d, x in prints}


def _slow(text: str | None) -> int:
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    ws = [w for w in ws if w]
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
