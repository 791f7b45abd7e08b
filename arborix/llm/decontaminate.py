"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A benchmark item's windows are its runs of ``size`` consecutive words (an item
of fewer words is one window). Documents stream past the broadcast set once; a
rolling hash over each document's words finds candidate windows, and a
comparison of the words themselves verifies each hit. The set is broadcast in
blocks of at most ``block_words`` words: one block for any usual benchmark,
several passes over the documents beyond that, so that the broadcast's size
is bounded whatever the benchmark's.

Defined cases: null and empty texts have no words and no hits; items without
words have no windows; repeated items count once per item_id; items without
item_id hit like others and count as one more item, absent from ``items``; repeated rows are
judged row by row; an empty table gives an empty result, an empty benchmark no
hits; columns named like a result are replaced, all others pass untouched.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Every ASCII byte that no word contains becomes a blank; A-Z become a-z.
FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
BITS = 22
BASE = 0x9E3779B97F4A7C15 | 1
#: Name of the column of hits while passes over blocks of the benchmark go on.
HITS = "__hits"


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of characters beyond ASCII."""
    return (text or b"").translate(FOLD).split()


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, by one multiply-add per word of the run."""
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= np.uint64(BASE)
        out += hashes[j : j + n]
    return out ^ (out >> np.uint64(29))


def hashed(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, ws), np.int64, len(ws)).view(np.uint64)


class Windows:
    """Different windows of one length: sorted hashes, where each window's words stand in the items' text, and its items. A
    bitmap of the hashes' first bits rejects most of what is looked up."""

    def __init__(self, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, items: np.ndarray, text: bytes) -> None:
        order = np.lexsort((items, hashes))
        hashes, begins, ends, items = hashes[order], begins[order], ends[order], items[order]
        first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        for k in np.flatnonzero(~first).tolist():  # an equal hash: as a rule the same window again
            first[k] = text[begins[k] : ends[k]] != text[begins[k - 1] : ends[k - 1]]
        self.text, self.items = text, items
        self.starts = np.append(np.flatnonzero(first), len(items))  # where each window's items begin
        self.hashes, self.begins, self.ends = hashes[first], begins[first], ends[first]
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.hashes >> np.uint64(64 - BITS)] = True

    def find(self, h: int, window: bytes) -> set[int]:
        """Numbers of the items that hold a window, compared word by word."""
        found: set[int] = set()
        k = int(np.searchsorted(self.hashes, np.uint64(h)))
        while k < len(self.hashes) and self.hashes[k] == h:
            if self.text[self.begins[k] : self.ends[k]] == window:
                found.update(self.items[self.starts[k] : self.starts[k + 1]].tolist())
            k += 1
        return found


class NgramSet:
    """Windows of a block of items, by length: about 30 bytes for each word of the block."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int) -> None:
        self.names = [item for item, _ in items]
        parts, held, at = [], defaultdict(list), 0
        for number, (_, text) in enumerate(items):
            ws = words(text)
            n = min(size, len(ws))
            if n:
                ends = at + np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
                begins = np.concatenate([[at], ends[:-1] + 1])
                count = len(ws) - n + 1
                held[n].append((rolling(hashed(ws), n), begins[:count], ends[n - 1 :], np.full(count, number, np.int32)))
                parts.append(b" ".join(ws))
                at = int(ends[-1]) + 1
        text = b" ".join(parts)
        self.windows = {n: Windows(*(np.concatenate(c) for c in zip(*found, strict=True)), text) for n, found in held.items()}

    def scan(self, ws: list[bytes]) -> list[tuple[int, int, set[str | None]]]:
        """(first word, words, items) of each verified hit."""
        out = []
        if ws:
            hashes = hashed(ws)
            for n, windows in self.windows.items():
                if len(ws) >= n:
                    rolled = rolling(hashes, n)
                    for i in np.flatnonzero(windows.bitmap[rolled >> np.uint64(64 - BITS)]).tolist():
                        if found := windows.find(int(rolled[i]), b" ".join(ws[i : i + n])):
                            out.append((i, n, {self.names[k] for k in found}))
        return out


@lru_cache(maxsize=1)
def _set(key: str, block: Broadcast, size: int) -> NgramSet:
    """The set that a worker keeps from task to task; ``key`` names the block."""
    return NgramSet(list(block.value), size)


common.held("decontaminate", _set.cache_clear)


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[tuple[int, int, Broadcast]]:
    """(number, count, items) of broadcasts of about ``block_words`` words each, one after the other."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("t")).filter("t IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] // 2  # a word and its blank take two bytes at least
    count = max(1, -(-total // block_words))
    for i in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == i).distinct().toLocalIterator()
        yield i, count, spark.sparkContext.broadcast(tuple(sorted(((r.item, bytes(r.t)) for r in rows), key=lambda r: (r[0] is None, r[0] or "", r[1]))))


SPANS = "array<struct<start:int,n:int,items:array<string>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("items", pa.list_(pa.string()))]))


def _scanner(block: Broadcast, key: str, size: int):
    def scan(texts: pa.Array) -> pa.Array:
        found = _set(key, block, size)
        return pa.array([[(i, n, sorted(items, key=lambda x: (x is None, x or ""))) for i, n, items in found.scan(words(t))] for t in common.utf8(texts)], _SPANS)

    return scan


def find_spans(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", size: int = 10, block_words: int = 2_000_000, into: str = HITS) -> DataFrame:
    """Documents with a column of verified hits: first word, number of words, item ids."""
    spark = documents.sparkSession
    out, run = documents, uuid.uuid4().hex
    scratch = common.Scratch(spark, "hits")
    for k, count, block in blocks_of(benchmark, block_words):
        hits = common.arrow_udf("decontaminate", _scanner(block, f"{run}-{k}", size), SPANS)(F.col(f"`{text}`"))
        out = out.withColumn(into, F.concat(into, hits) if k else hits)
        if count > 1:  # one pass at a time, so that a worker holds one block
            out = scratch.save(out, f"pass{k}")
            if k:
                scratch.drop(f"pass{k - 1}")
    return out


@common.shielded
def measure(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents with n_words, n_hit, n_items, items (sorted), contaminated."""
    found = find_spans(documents, benchmark, **options)

    def digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for t, hits in zip(common.utf8(texts), spans.to_pylist(), strict=True):
            ws = words(t)
            hit = np.zeros(len(ws), bool)
            for h in hits:
                hit[h["start"] : h["start"] + h["n"]] = True
            items = {x for h in hits for x in h["items"]}
            rows.append((len(ws), int(hit.sum()), len(items), sorted(items - {None})))
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string()))]))

    text = options.get("text", "text")
    measured = found.withColumn(HITS, common.arrow_udf("decontaminate", digest, "n_words long, n_hit long, n_items long, items array<string>")(F.col(f"`{text}`"), F.col(HITS)))
    names = ("n_words", "n_hit", "n_items", "items")
    return measured.withColumns({n: F.col(f"{HITS}.{n}") for n in names}).withColumn("contaminated", F.col("n_hit") > 0).drop(HITS)


@common.shielded
def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """Drops contaminated documents, or (``remove="spans"``) cuts hit words and what stands between them."""
    found = find_spans(documents, benchmark, text=text, **options)
    if remove == "documents":
        return found.filter(F.size(HITS) == 0).drop(HITS)
    if remove != "spans":
        raise ValueError(f"remove: documents or spans, not {remove!r}")

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, hits in zip(common.utf8(texts), spans.to_pylist(), strict=True):
            if hits:
                folded, at, places = t.translate(FOLD), 0, []
                for w in folded.split():
                    at = folded.index(w, at)
                    places.append((at, at + len(w)))
                    at += len(w)
                kept, last = [], 0
                for i, n in sorted((h["start"], h["n"]) for h in hits):
                    a, b = places[i][0], places[i + n - 1][1]
                    kept.append(t[last : max(a, last)])
                    last = max(last, b)
                t = b"".join([*kept, t[last:]])
            out.append(None if t is None else t.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return found.withColumn(text, common.arrow_udf("decontaminate", cut, "string")(F.col(f"`{text}`"), F.col(HITS))).drop(HITS)


def op1_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    docs = documents.select("doc_id", "text")
    return measure(docs, benchmark.select("item_id", "text")).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def brute_force(documents: list[tuple[int, str | None]], items: list[tuple[int, str | None]], size: int = 10) -> dict[int, tuple]:
    """Every window against every place, for tests."""
    out = {}
    for doc, text in documents:
        ws, hit, found = words(text.encode() if text is not None else None), set(), set()
        for item, t in items:
            iw = words(t.encode() if t is not None else None)
            n = min(size, len(iw))
            for i in range(len(iw) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == iw[i : i + n]:
                        hit |= set(range(p, p + n))
                        found.add(None if item is None else str(item))
        out[doc] = (len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit))
    return out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
bg AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM bw),
lens AS (SELECT DISTINCT n FROM bg),
dw AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n),
h AS (SELECT dw.doc_id, dw.i, dw.n, bg.item FROM (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM dw) dw JOIN bg ON bg.g = dw.g AND bg.n = dw.n),
hw AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
