"""Suffix-array dedup: every byte covered by a string of 400 bytes that starts anywhere else, and every word of a
passage of over 50 words that stands anywhere else.

An array of all suffixes is too large to move at 100 TB, so suffixes are
sampled, and sampling loses nothing: among the strings of ``sizes[0]`` symbols
(bytes, or words) inside a window of ``window`` symbols the one with the least
hash is the window's anchor, equal windows have equal anchors, and consecutive
windows with one anchor form a segment. Each segment samples one suffix, that
which begins at its anchor.

A batch's suffix array holds its sampled suffixes, sorted by their first eight
letters and then by a hash of their first ``sizes[0]`` symbols. It enters a
logarithmic family of such arrays: on its way in it is merge-scanned against
every level for suffixes with that prefix in common, and two levels of a size
merge into one of twice the size.

What has a prefix in common is looked at more closely. Segments equal as a
whole (by 128 bits of a hash) are matches. Segments that differ may have some
windows in common: of a few under one anchor, the common lengths to the left and
to the right of the anchor are counted symbol by symbol; of more than ``few``, one of
each different segment is sampled again with longer strings (shorter segments)
and then window by window, so that no task compares all pairs of a large group.

Defined cases: null and empty texts, and texts shorter than a window, have
nothing removed; matches never cross documents; repeated rows are documents of
their own, so all their bytes go if they are long enough; very long texts are
read in pieces of bounded size; columns named like a result are replaced.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .runs import Runs

PIECE = 1 << 17
NO_ID = -(1 << 63)
_RANDOM = np.random.default_rng(400)
TABLE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Unit:
    """What windows consist of. sizes: symbols of an anchor, from the family's to whole windows."""

    kind: int
    window: int
    sizes: tuple[int, ...]


BYTES, WORDS = Unit(0, 400, (100, 360, 400)), Unit(1, 51, (8, 44, 51))
UNITS = (BYTES, WORDS)
LENGTH = BYTES.window


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(PIECE + 2 * LENGTH, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


common.held("suffixes", powers.cache_clear)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k values: differences of one running sum, shifted back to the same power."""
    up, down = powers()
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[: len(values) - k + 1])


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    out, span = values, 1
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return out if span == width else np.minimum(out[: len(out) - (width - span)], out[width - span :])


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than blanks, A-Z lower-cased."""
    return text.lower().split()


@dataclass
class Piece:
    """Symbols of several texts, or of a part of one: a hash of each, all letters, and where each symbol begins in them."""

    hashes: np.ndarray
    letters: bytes
    begins: np.ndarray
    rows: np.ndarray  # number of each text
    offsets: np.ndarray  # where each text's symbols begin, and an end
    firsts: np.ndarray  # the number of each text's first symbol here


def parts_of(text: bytes, unit: Unit) -> Iterator[tuple[int, bytes | list[bytes]]]:
    """(first symbol, symbols) of a text's parts, which overlap by a window less one symbol; parts shorter than a window are left out."""
    more = unit.window - 1
    if unit.kind == BYTES.kind:
        for a in range(0, len(text) - more, PIECE):
            yield a, text[a : a + PIECE + more]
        return
    at, first, held = 0, 0, []
    while at < len(text):
        end = len(text)
        if at + PIECE < end:  # not inside a word
            cut = text.find(b" ", at + PIECE)
            end = cut if cut >= 0 else end
        held += words(text[at:end])
        at = end
        if len(held) > more:
            for a in range(0, len(held) - more, PIECE):
                yield first + a, held[a : a + PIECE + more]
            first, held = first + len(held) - more, held[len(held) - more :]


def pieces(texts: list[bytes | None], unit: Unit) -> Iterator[Piece]:
    """The texts' symbols, small texts together."""
    held, size = [], 0

    def piece() -> Piece:
        rows, firsts, parts = zip(*held, strict=True)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        if unit.kind == BYTES.kind:
            letters = b"".join(parts)
            return Piece(TABLE[np.frombuffer(letters, np.uint8)], letters, np.arange(len(letters) + 1), np.array(rows), offsets, np.array(firsts))
        every = [w for p in parts for w in p]
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, every), np.int64, len(every)) + 1)])
        return Piece(np.fromiter(map(xxhash.xxh64_intdigest, every), np.uint64, len(every)), b" ".join(every) + b" ", begins, np.array(rows), offsets, np.array(firsts))

    for row, text in enumerate(texts):
        for first, part in parts_of(text or b"", unit):
            if held and size + len(part) > PIECE + LENGTH:
                yield piece()
                held, size = [], 0
            held.append((row, first, part))
            size += len(part)
    if held:
        yield piece()


def segments(texts: list[bytes | None], unit: Unit, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the text, start, windows, place of the anchor, first letters, anchor, fingerprint high, low) of the texts' segments."""
    for p in pieces(texts, unit):
        grams = rolling(p.hashes, k)
        able = np.zeros(len(p.hashes) + 1, np.int8)  # windows within one text
        able[p.offsets[:-1]] += 1
        np.add.at(able, p.offsets[1:] - unit.window + 1, -1)
        able = np.flatnonzero(np.cumsum(able[:-1]))
        if k == unit.window:
            at, first = able, np.arange(len(able))
        else:
            keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # ties: the first
            at = (least_in_windows(keyed, unit.window - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[able]
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (able[1:] != able[:-1] + 1)]))
        n = np.diff(np.append(first, len(able)))
        start, at = able[first], at[first]
        ends = p.begins[start + n + unit.window - 1].tolist()
        digests = b"".join([xxhash.xxh3_128_digest(p.letters[a:b]) for a, b in zip(p.begins[start].tolist(), ends, strict=True)])
        prints = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        padded = np.frombuffer(p.letters + bytes(8), np.uint8)
        head = np.ascontiguousarray(padded[p.begins[at][:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
        of = np.searchsorted(p.offsets, start, "right") - 1
        yield p.rows[of], start - p.offsets[of] + p.firsts[of], n, at - start, head, grams[at], prints[:, 0], prints[:, 1]


ENTRY = "kind byte, owner long, mark long, start int, n int, at int, head long, anchor long, f1 long, f2 long"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def sample(rows: DataFrame, units: tuple[Unit, ...], level: int) -> DataFrame:
    """The sampled suffixes of rows (owner, mark, text): for each segment its place, its order and its fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        owner, mark, texts, cols = batch.column(0).to_numpy(), batch.column(1).to_numpy(), common.utf8(batch.column(2)), []
        for unit in units:
            for row, start, n, at, *prints in segments(texts, unit, unit.sizes[level]):
                prints[1] = prints[1] ^ np.uint64(unit.kind)  # bytes and words are apart
                cols.append((np.full(len(n), unit.kind, np.int8), owner[row], mark[row], start.astype(np.int32), n.astype(np.int32), at.astype(np.int32), *map(common.signed, prints)))
        if not cols:
            return None
        return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], names=NAMES)

    return common.arrow_map("suffixes", rows, run, ENTRY)


class SuffixIndex:
    """A logarithmic family of arrays of sampled suffixes: each prefix, in the order of its letters, and how often."""

    def __init__(self, spark, *, fan_out: int = 2, buckets: int | None = None) -> None:
        self.runs = Runs(spark, "suffixes", ["head", "anchor"], {"copies": "sum"}, fan_out=fan_out, buckets=buckets)

    def add(self, entries: DataFrame) -> DataFrame:
        """A batch's suffix array joins the family. Prefixes (head, anchor) that it has more than once, or in common with a level."""
        array = self.runs.append(entries.groupBy("head", "anchor").agg(F.count("*").alias("copies")))
        found = array.filter("copies > 1").select("head", "anchor")
        for level in self.runs.before():
            found = found.unionByName(array.join(level.hint("merge"), ["head", "anchor"], "left_semi").select("head", "anchor"))
        return found

    def compact(self) -> None:
        self.runs.compact()

    def close(self) -> None:
        self.runs.close()


def settle(spark) -> None:
    gc.collect()
    common.free_shuffles(spark)


KEY = ["head", "anchor", "f1", "f2"]


def repeated_windows(documents: DataFrame, scratch: common.Scratch, *, units: tuple[Unit, ...] = UNITS, batches: int = 4, few: int = 32) -> DataFrame:
    """(owner, mark, kind, start, n): runs of n windows from start on that occur elsewhere. documents: (owner, mark, text)."""
    spark = documents.sparkSession
    entries = scratch.save(sample(documents, units, 0).withColumn("batch", F.pmod("mark", F.lit(batches))), "entries", by=("batch",))
    index, found = SuffixIndex(spark, buckets=common.partitions(documents)), []
    try:
        for k in range(batches):
            found.append(scratch.save(index.add(entries.filter(F.col("batch") == k)), f"found{k}"))
            if k + 1 < batches:  # nothing is scanned against the last state
                index.compact()
    finally:
        index.close()
    # tables, and the same joins at every size: Spark can split a frequent string's rows, and what moves grows as the input does
    prefixes = scratch.save(union(found).distinct(), "prefixes")
    close = scratch.save(entries.drop("batch").join(prefixes.hint("merge"), ["head", "anchor"]), "close")
    scratch.drop("entries", "prefixes", *(f"found{k}" for k in range(batches)))
    settle(spark)
    # any one row of each: an aggregate's firsts are of one row, and numbers need no sort
    any_row = [F.first(c).alias(c) for c in ("kind", "owner", "mark", "start", "n", "at")]
    different = scratch.save(close.groupBy(*KEY).agg(F.count("*").alias("copies"), *any_row), "different")
    equal = scratch.save(different.filter("copies > 1").select(*KEY), "equal")
    windows = [scratch.save(close.join(equal.hint("merge"), KEY, "left_semi").select("owner", "mark", "kind", "start", "n"), "whole")]
    scratch.drop("close", "equal")
    # one of each different segment under an anchor that has several, not all of them repeated
    kinds = different.groupBy("head", "anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).filter("kinds > 1 AND fewest = 1")
    kinds = scratch.save(kinds.select("head", "anchor", "kinds"), "kinds")
    undecided = different.join(kinds.hint("merge"), ["head", "anchor"]).select("anchor", "kind", "kinds", (F.col("copies") == 1).alias("open"), "owner", "mark", "start", "n", "at")
    grouped = scratch.save(undecided, "undecided").groupBy("owner", "mark").agg(F.collect_list(F.struct("kind", "start", "n", "at", "anchor", "kinds", "open")).alias("ranges"))
    cut = documents.join(grouped.hint("merge"), ["owner", "mark"]).select("owner", "mark", "text", "ranges")
    held = scratch.save(cut_out(cut, units), "held")
    scratch.drop("different", "kinds", "undecided")
    settle(spark)
    small = held.filter(F.col("kinds") <= few).repartition(common.partitions(documents), "anchor").sortWithinPartitions("anchor")
    windows.append(scratch.save(common.arrow_stream("suffixes", small, compare(units), "owner long, mark long, kind byte, start int, n int"), "parts"))
    windows += finer(held.filter(F.col("kinds") > few), scratch, units)
    scratch.drop("held")
    return union(windows)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


HELD = "id long, owner long, mark long, kind byte, start int, n int, at int, anchor long, kinds long, open boolean, text binary"


def cut_out(rows: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """The symbols of each of a document's segments."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for owner, mark, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            wanted = {(r["kind"], r["start"], r["n"], r["at"], r["anchor"], r["kinds"], r["open"]) for r in ranges}  # repeated rows find their segments only once
            for unit in units:
                if mine := sorted(r for r in wanted if r[0] == unit.kind):
                    symbols = words(text) if unit.kind == WORDS.kind else text
                    for r in mine:
                        part = symbols[r[1] : r[1] + r[2] + unit.window - 1]
                        out.append((owner, mark, *r, b" ".join(part) if unit.kind == WORDS.kind else part))
        if not out:
            return None
        types = (pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in HELD.split(", ")][1:])

    return common.arrow_map("suffixes", rows, run, HELD.split(", ", 1)[1]).withColumn("id", F.monotonically_increasing_id())


def in_common(a: bytes | list, b: bytes | list) -> int:
    """Symbols that two sequences begin with in common."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def compare(units: tuple[Unit, ...]):
    """Partitions of segments sorted by anchor -> (owner, mark, kind, start, n): the windows that segments under one anchor share."""
    window = {u.kind: u.window for u in units}

    def shared(rows: list[dict]) -> Iterator[tuple]:
        sides = []
        for r in rows:
            symbols = r["text"].split(b" ") if r["kind"] == WORDS.kind else r["text"]
            sides.append((symbols[: r["at"]][::-1], symbols[r["at"] :]))
        for i, j in itertools.combinations(range(len(rows)), 2):
            x, y = rows[i], rows[j]
            if x["kind"] == y["kind"] and (x["open"] or y["open"]):
                left, right = in_common(sides[i][0], sides[j][0]), in_common(sides[i][1], sides[j][1])
                n = left + right - window[x["kind"]] + 1
                if n > 0:
                    for r in (x, y):
                        if r["open"]:
                            yield r["owner"], r["mark"], r["kind"], r["start"] + r["at"] - left, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], []
        for batch in itertools.chain(batches, [None]):
            for row in [None] if batch is None else batch.to_pylist():
                if group and (row is None or row["anchor"] != group[0]["anchor"]):
                    out += shared(group)
                    group = []
                group.append(row)
            if out:
                types = (pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["owner", "mark", "kind", "start", "n"])
                out = []

    return run


def finer(held: DataFrame, scratch: common.Scratch, units: tuple[Unit, ...]) -> list[DataFrame]:
    """What the segments of large groups share: found by shorter segments of theirs, and where those differ, window by window."""
    held, out = held.select("id", "owner", "mark", "kind", "start", "text"), []
    if held.isEmpty():
        return out
    for level in range(1, len(BYTES.sizes)):
        rows = held.select(F.col("id").alias("owner"), F.col("kind").cast("long").alias("mark"), "text")
        entries = scratch.save(union([sample(rows.filter(F.col("mark") == u.kind), (u,), level) for u in units]), f"entries{level}")
        different = entries.groupBy(*KEY).agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("owner", "start", "n")])
        different = scratch.save(different, f"different{level}")
        again = entries.join(different.filter("copies > 1").select(*KEY).hint("merge"), KEY, "left_semi").select(F.col("owner").alias("id"), F.col("start").alias("at"), "n")
        placed = held.drop("text").join(again.hint("merge"), "id")  # places inside a segment -> places in its document
        out.append(scratch.save(placed.select("owner", "mark", "kind", (F.col("start") + F.col("at")).alias("start"), "n"), f"again{level}"))
        scratch.drop(f"entries{level}")
        if level + 1 < len(BYTES.sizes):
            kinds = different.groupBy("head", "anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).filter("kinds > 1 AND fewest = 1")
            kinds = scratch.save(kinds.select("head", "anchor"), f"kinds{level}")
            ranges = different.join(kinds.hint("merge"), ["head", "anchor"], "left_semi").groupBy(F.col("owner").alias("id")).agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
            held = scratch.save(cut_again(held.join(ranges.hint("merge"), "id"), units).withColumn("id", F.monotonically_increasing_id()), f"held{level}")
    return out


def cut_again(rows: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Parts of cut segments, as segments of their own."""
    window = {u.kind: u.window for u in units}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for row in batch.to_pylist():
            kind = row["kind"]
            symbols = row["text"].split(b" ") if kind == WORDS.kind else row["text"]
            for r in row["ranges"]:
                part = symbols[r["start"] : r["start"] + r["n"] + window[kind] - 1]
                out.append((row["owner"], row["mark"], kind, row["start"] + r["start"], b" ".join(part) if kind == WORDS.kind else part))
        types = (pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["owner", "mark", "kind", "start", "text"]) if out else None

    return common.arrow_map("suffixes", rows.select("owner", "mark", "kind", "start", "text", "ranges"), run, "owner long, mark long, kind byte, start int, text binary")


def covered(size: int, runs: list[dict] | None, kind: int = BYTES.kind, window: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal ranges of symbols that runs of windows cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], min(size, r["start"] + r["n"] - 1 + window)) for r in runs or () if r["kind"] == kind):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: Words in a text's bytes: runs of what is no blank.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """A text without some ranges of its bytes, in any order."""
    out, at = [], 0
    for a, b in sorted(ranges):
        out.append(text[at : max(a, at)])
        at = max(at, b)
    return b"".join([*out, text[at:]])


RESULTS = "n_removed long, spans array<struct<start:long,end:long>>, kept binary, n_repeated_words long, passages array<struct<start:long,end:long>>, left string"


@common.shielded
def dedup_substrings(documents: DataFrame, **options) -> DataFrame:
    """Documents with spans (start, end of each removed run of bytes), n_bytes, n_removed, kept (binary), passages (first word and
    end of each maximal run of words in passages of over 50 words that stand elsewhere), n_repeated_words and left (the text
    without spans and passages); columns of these names are replaced."""
    spark = documents.sparkSession
    scratch = common.Scratch(spark, "suffix")
    marked = documents.withColumns({"__owner": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__mark": F.xxhash64("text")})
    try:
        windows = repeated_windows(marked.select(F.col("__owner").alias("owner"), F.col("__mark").alias("mark"), "text"), scratch, **options)
        grouped = windows.groupBy(F.col("owner").alias("__owner"), F.col("mark").alias("__mark"))
        runs = scratch.keep(grouped.agg(F.collect_set(F.struct("kind", "start", "n")).alias("__runs")))
    finally:
        scratch.close()
    settle(spark)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.struct([("n_removed", pa.int64()), ("spans", kinds), ("kept", pa.binary()), ("n_repeated_words", pa.int64()), ("passages", kinds), ("left", pa.string())])

    def run(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(common.utf8(texts), runs.to_pylist(), strict=True):
            if not found:
                out.append(None)
                continue
            spans, passages = covered(len(text), found), covered(1 << 62, found, WORDS.kind, WORDS.window)
            kept = left = without(text, spans)
            if passages:
                at = [m.span() for m in WORD.finditer(text)]
                left = without(text, [*spans, *((at[a][0], at[b - 1][1]) for a, b in passages)])
            ranges = [[{"start": a, "end": b} for a, b in some] for some in (spans, passages)]
            out.append((len(text) - len(kept), ranges[0], kept, sum(b - a for a, b in passages), ranges[1], left.decode("utf-8", "replace")))
        return pa.array(out, schema)

    joined = marked.join(runs.hint("merge"), ["__owner", "__mark"], "left")
    # texts that nothing is found in do not go to Python
    joined = joined.withColumn("__cut", common.arrow_udf("suffixes", run, RESULTS)(F.when(F.col("__runs").isNotNull(), F.col("text")), F.col("__runs")))
    cut, none = F.col("__cut"), F.array().cast("array<struct<start:long,end:long>>")
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    results = {"n_bytes": F.octet_length(whole).cast("long"), "n_removed": F.coalesce(cut["n_removed"], F.lit(0).cast("long")), "spans": F.coalesce(cut["spans"], none), "kept": F.coalesce(cut["kept"], whole), "n_repeated_words": F.coalesce(cut["n_repeated_words"], F.lit(0).cast("long")), "passages": F.coalesce(cut["passages"], none), "left": F.coalesce(cut["left"], F.col("text"))}
    return joined.select(*common.columns(documents, but=list(results)), *[c.alias(n) for n, c in results.items()])


def op10_suffix_dedup(documents: DataFrame) -> DataFrame:
    """The contract's row for each document, how many of its words are in passages of over 50 words that stand elsewhere, and
    the text without the removed bytes and those passages."""
    cut = dedup_substrings(documents.select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words", F.col("left").alias("text"))


def brute_force(documents: list[tuple[int, str | None]]) -> list[tuple]:
    """A count of every string of the length, for tests: the query's rows."""
    texts = dict(documents)
    data = [(d, (t or "").encode()) for d, t in documents]

    def gone(units: list, window: int) -> list[np.ndarray]:
        count: dict[bytes, int] = {}
        sign = lambda u, i: hashlib.blake2b(u[i : i + window] if isinstance(u, bytes) else b" ".join(u[i : i + window]), digest_size=16).digest()
        for u in units:
            for i in range(len(u) - window + 1):
                count[sign(u, i)] = count.get(sign(u, i), 0) + 1
        out = []
        for u in units:
            hit = np.zeros(len(u), bool)
            for i in range(len(u) - window + 1):
                if count[sign(u, i)] > 1:
                    hit[i : i + window] = True
            out.append(hit)
        return out

    out = []
    for (d, b), hit, said in zip(data, gone([b for _, b in data], LENGTH), gone([words(b) for _, b in data], WORDS.window), strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        gone_too, at = hit.copy(), [m.span() for m in WORD.finditer(b)]
        for k in np.flatnonzero(said).tolist():  # words, and what stands between them
            gone_too[at[k][0] : at[k][1]] = True
            if k + 1 < len(said) and said[k + 1]:
                gone_too[at[k][1] : at[k + 1][0]] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone_too]).decode("utf-8", "replace")
        out.append((d, len(b), int(hit.sum()), int((hit & ~np.concatenate([[False], hit[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest(), int(said.sum()), None if texts[d] is None else left))
    return out
