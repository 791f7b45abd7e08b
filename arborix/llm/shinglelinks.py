"""Links between texts by their word shingles, for near copies that no two fingerprint bits can tell.

An edit of a word moves a 64-bit fingerprint by several bits, so near copies in
the sense of shingles (five words, Jaccard similarity of 0.8 or more) are looked
for beside the fingerprint links: texts that agree on a band of minimum hashes
are candidates, pivot distances of their fingerprints discard those that differ
by too much in any coordinate, the share of equal minimum hashes picks each text's
most like one, and the shingles of both verify it. Those first links join most
texts of a group; what they leave apart is compared again (``rest``): of each band
whose texts are in several components, every pair of two components whose share
allows it is verified, so a guess that fails never hides another link.

In the first pass a band with over ``crowd`` texts is not paired up: each of its
texts is compared with the first ``crowd`` leaders, texts that are like none
before them, so a band takes time in proportion to its texts. That only saves
work: the second pass compares all texts of such a band that are still apart.
Those outside of the band's largest component meet each other and it, dealt over
cells of about ``crowd`` texts for each two shares, so that no task holds more than
two shares; the texts of the largest component, which need not meet each other,
are copied for the shares of the others only.

Defined cases: null texts and texts without words have no signature and no link;
a text of fewer than five words is one shingle, so it is linked to equal words only;
equal texts have one mark and count once; an empty table gives no links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: Minimum hashes of a text, and how many make a band: 21 bands find a pair at 0.8 in 998 of 1,000 cases.
ROWS, BANDS = 6, 21
BINS = ROWS * BANDS
FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Fingerprint bits in which texts at 0.8 differ at most, but for one in ten thousand.
REACH = 22


def shingle_hashes(text: bytes | None, size: int = 5) -> np.ndarray:
    """Different hashes of a text's shingles of ``size`` words; one of all its words if it has fewer, none if it has none."""
    ws = (text or b"").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= size:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate([[0], ends[:-size]])
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of a number of random maps. (One hash cut into ranges would be cheaper, but in
    a short text one shingle fills many ranges, and a line that many texts share would make them all candidates.)"""
    out = np.full(BINS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(hashes), 2048):
        some = hashes[k : k + 2048, None] * FACTORS[None, :]
        np.minimum(out, (some >> np.uint64(32)).min(axis=0).astype(np.uint32), out=out)
    return out


def signature(text: bytes | None) -> tuple[int, list[int], bytes, int] | None:
    """(fingerprint, band keys, minimum hashes, number of shingles) of a text; None without words."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return None
    low = minima(hashes)
    keys = [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return simhash.majority(hashes), keys, low.tobytes(), len(hashes)


_SIGNATURE = pa.struct([("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("low", pa.binary()), ("size", pa.int64())])


def _signatures(texts: pa.Array) -> pa.Array:
    out = []
    for t in common.utf8(texts):
        s = signature(t)
        out.append(None if s is None else (int(np.uint64(s[0]).astype(np.int64)), common.signed(np.array(s[1], np.uint64)).tolist(), *s[2:]))
    return pa.array(out, _SIGNATURE)


def likeness(low: np.ndarray, fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal minimum hashes of pairs (a, b) of rows; 0 where a pivot's distances differ too much."""
    table = np.bitwise_count(fps[:, None] ^ simhash.PIVOTS[None, :]).astype(np.int8)
    kept = np.arange(len(a))
    for p in range(table.shape[1]):
        kept = kept[np.abs(table[a[kept], p] - table[b[kept], p]) <= REACH]
    out = np.zeros(len(a))
    for k in range(0, len(kept), 4096):
        some = kept[k : k + 4096]
        out[some] = (low[a[some]] == low[b[some]]).mean(axis=1)
    return out


def pair_up(similarity: float, crowd: int):
    """Partitions sorted by key -> (a, b): each of a key's texts with the earlier one that is most like it, if it is like any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, fps, low = None, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, BINS), np.uint32)
        for batch in batches:
            keys, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prints = batch.column(2).to_numpy().view(np.uint64)
            lows = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, BINS)
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for s, e in itertools.pairwise([0, *edges.tolist(), len(keys)]):
                if keys[s] != key:
                    key, ids, fps, low = keys[s], ids[:0], fps[:0], low[:0]
                for a in range(s, e, 256):  # the members so far, and a block of new ones
                    n, m = len(ids), min(e, a + 256) - a
                    ids, fps, low = np.concatenate([ids, marks[a : a + m]]), np.concatenate([fps, prints[a : a + m]]), np.vstack([low, lows[a : a + m]])
                    new, old = np.divmod(np.arange(m * (n + m)), n + m)
                    new = new + n
                    new, old = new[old < new], old[old < new]
                    share = likeness(low, fps, new, old).reshape(-1) if len(new) else np.zeros(0)
                    order = np.lexsort((-share, new))
                    order = order[np.concatenate([[True], new[order][1:] != new[order][:-1]])] if len(order) else order
                    best = order[share[order] >= similarity]
                    if len(best):
                        yield pa.record_batch({"a": ids[new[best]], "b": ids[old[best]]})
                    if n + m > crowd:  # only leaders stay, those like none before them, and no more than a crowd of these
                        follows = np.zeros(n + m, bool)
                        follows[new[best]] = True
                        stay = np.flatnonzero(~follows)[:crowd]
                        ids, fps, low = ids[stay], fps[stay], low[stay]

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def jaccard(a: bytes | None, b: bytes | None) -> float:
    return overlap(shingle_hashes(a), shingle_hashes(b))


def _jaccards(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([jaccard(x, y) for x, y in zip(common.utf8(a), common.utf8(b), strict=True)], pa.float64())


def _hashes(texts: pa.Array) -> pa.Array:
    return pa.array([shingle_hashes(t).tobytes() for t in common.utf8(texts)], pa.binary())


#: Shingles that a share of a band in the second pass has at most, for one text of more: 8 bytes each.
SHARE = 1 << 20


def join_up(similarity: float, slack: float):
    """Partitions sorted by cell -> (a, b): links, verified, that join a cell's components as far as any pair does."""

    def joined(rows: pa.Table) -> pa.RecordBatch:
        ids, fps = rows["mark"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        low = np.frombuffer(b"".join(rows["low"].to_pylist()), np.uint32).reshape(-1, BINS)
        sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"].to_pylist()]
        sizes, label = np.array([len(h) for h in sets]), np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
        share_of, one = rows["share"].to_numpy(), rows["one"][0].as_py()
        out_a, out_b = [], []
        for s in range(0, len(ids), 256):
            new, old = np.divmod(np.arange(min(256, len(ids) - s) * len(ids)), len(ids))
            new = new + s
            able = (old < new) & (one | (share_of[new] != share_of[old])) & (label[new] != label[old])  # pairs of one share meet in its own cell
            able &= np.minimum(sizes[new], sizes[old]) >= similarity * np.maximum(sizes[new], sizes[old])
            new, old = new[able], old[able]
            share = likeness(low, fps, new, old)
            order = np.argsort(-share, kind="stable")
            order = order[share[order] >= similarity - slack]
            for x, y in zip(new[order].tolist(), old[order].tolist(), strict=True):
                if label[x] != label[y] and overlap(sets[x], sets[y]) >= similarity:
                    out_a.append(ids[x])
                    out_b.append(ids[y])
                    label[label == label[x]] = label[y]
        return pa.record_batch({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for s, e in itertools.pairwise([0, *edges.tolist(), len(keys)]):
                if s == e:
                    continue
                if held and keys[s] != key:
                    yield joined(pa.Table.from_batches(held))
                    held = []
                key = keys[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield joined(pa.Table.from_batches(held))

    return run


def rest(texts: DataFrame, wanted: DataFrame, each: DataFrame, first: DataFrame, scratch: common.Scratch, similarity: float, slack: float, crowd: int) -> DataFrame:
    """(a, b): what joins the components of the first links further, from all pairs in a band that are in different ones."""
    rounds = common.Scratch(texts.sparkSession, "rest")
    roots = scratch.save(simhash.components(first, rounds), "roots")
    rounds.close()
    labelled = wanted.join(roots.withColumnRenamed("node", "mark").hint("merge"), "mark", "left").select("key", "mark", "size", F.coalesce("root", "mark").alias("root"))
    labelled = scratch.save(labelled, "labelled")
    parts = labelled.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = scratch.save(parts, "parts")
    whole = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("most")).filter(F.col("n") > F.col("most.n"))
    shares = lambda n, size: F.ceil(F.greatest(n / F.lit(crowd), size / F.lit(SHARE))).cast("int")
    of_others, of_most = shares(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")), shares(F.col("most.n"), F.col("most.size"))
    apart = scratch.save(whole.select("key", F.col("most.root").alias("largest"), of_others.alias("others"), of_most.alias("rest")), "apart")
    members = labelled.join(apart.hint("merge"), "key").withColumn("in_largest", F.col("root") == F.col("largest"))
    # shares are numbered through: those of the others first
    mine = F.when(F.col("in_largest"), F.col("others") + F.pmod(F.xxhash64("mark"), "rest")).otherwise(F.pmod(F.xxhash64("mark"), "others")).cast("int")
    upto = F.when(F.col("in_largest"), F.col("others")).otherwise(F.col("others") + F.col("rest")) - 1
    members = members.withColumn("share", mine).withColumn("with", F.explode(F.sequence(F.lit(0), upto)))
    cell = F.xxhash64("key", F.least("share", "with"), F.greatest("share", "with"))
    members = scratch.save(members.select(cell.alias("cell"), "mark", "root", "share", (F.col("share") == F.col("with")).alias("one")), "members")
    marks = scratch.save(members.select("mark").distinct(), "marks")
    # copies go before the join, task by task: a join first would bring all copies of a text to one task (as Spark does
    # with a semi join, which it moves below the aggregate; marks are distinct, so an inner one is the same)
    bodies = texts.dropDuplicates(["mark"]).join(marks.hint("merge"), "mark").select("mark", common.arrow_udf("near", _hashes, "binary")("text").alias("hashes"))
    bodies = scratch.save(bodies.join(each.select("mark", "fp", "low").hint("merge"), "mark"), "hashes")
    rows = members.join(bodies.hint("merge"), "mark").select("cell", "mark", "root", "share", "one", "fp", "low", "hashes")
    parts = common.partitions(texts)
    return common.arrow_stream("near", rows.repartition(parts, "cell").sortWithinPartitions("cell", "mark"), join_up(similarity, slack), "a long, b long")


def links(texts: DataFrame, scratch: common.Scratch, *, similarity: float = 0.8, slack: float = 0.1, crowd: int = 512) -> DataFrame:
    """(a, b) of different texts (mark, text) that are near copies: candidates by their minimum hashes, with some slack,
    verified by their shingles. They join all texts that the verified candidates join; not every pair is among them."""
    # a table before the filter: a filter on a function's result would have it computed twice
    signed = scratch.save(texts.select("mark", common.arrow_udf("near", _signatures, "fp long, keys array<long>, low binary, size long")("text").alias("s")), "signatures")
    each = signed.filter("s IS NOT NULL").select("mark", "s.*").dropDuplicates(["mark"])
    keyed = scratch.save(each.select(F.explode("keys").alias("key"), "mark", "size"), "keyed")
    shared = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared")
    wanted = scratch.save(keyed.join(shared.hint("merge"), "key", "left_semi"), "wanted")
    scratch.drop("keyed")
    rows = wanted.join(each.select("mark", "fp", "low").hint("merge"), "mark").select("key", "mark", "fp", "low")
    parts = common.partitions(texts)
    found = common.arrow_stream("near", rows.repartition(parts, "key").sortWithinPartitions("key", "mark"), pair_up(similarity - slack, crowd), "a long, b long")
    found = scratch.save(found.distinct(), "candidates")
    ends = found.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    bodies = scratch.save(texts.dropDuplicates(["mark"]).join(ends.hint("merge"), "mark"), "bodies")
    a, b = (bodies.select(F.col("mark").alias(c), F.col("text").alias(f"text_{c}")).hint("merge") for c in "ab")
    verified = found.join(a, "a").join(b, "b").withColumn("j", common.arrow_udf("near", _jaccards, "double")("text_a", "text_b"))
    first = scratch.save(verified.filter(F.col("j") >= similarity).select("a", "b"), "first")
    scratch.drop("bodies")
    return first.unionByName(rest(texts, wanted, each, first, scratch, similarity, slack, crowd)).distinct()
