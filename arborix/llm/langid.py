"""Language ID by interpolated Kneser-Ney character models, one per language.

Counts of character 4-grams are gathered from every labelled document (partial
counts per task, summed by key), and the lower orders follow by continuation
counts; nothing is cut. Probabilities are resolved for all languages and kept
in arrays sorted by a hash of the n-gram, with a directory of the hash's first
bits: scoring a text is a few array reads for each character. The language of
least cross-entropy per character wins; the least entropies of all of each
language's different labelled texts calibrate above which a text counts as no
known language.

Arrays of more than ``max_cells`` probabilities are cut into shares by the last
letter but one of an n-gram. All orders and contexts that a position needs have
the same one, so each share adds up the cross-entropy of its own positions in
its own pass over the texts, and the shares' sums are the whole: what is
broadcast at once is bounded (a share holds one letter's contexts at least),
what is learned is not.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and are rejected; documents without language or text teach nothing, those
without id are not held out; with
nothing to learn from, every text is ``und``; ties go to the first language in
code point order; repeated rows count as often as they occur; a language none of
whose texts is told right has no limit, and nothing told to be in it is
rejected; an empty table gives an empty result; columns named like a result are
replaced.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER, WIDTH = 4, 15
FIELD = (1 << WIDTH) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters of evidence that count in a score: more would only say 1.0.
EVIDENCE = 64


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Code point -> symbol: lower-cased letters and marks keep their code point (beyond 15 bits a hash of it), all else is 0."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha() or unicodedata.category(ch)[0] == "M":
            low = ord(ch.lower()[0])
            out[c] = low if low <= FIELD // 2 else FIELD // 2 + 1 + low * 2654435761 % (FIELD // 2)
    return out


common.held("langid", symbols.cache_clear)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, runs of non-letters as one 0, and each text's end."""
    table, parts, ends, n = symbols(), [], np.zeros(len(texts), np.int64), 0
    for k, t in enumerate(texts):
        if t:
            s = table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
            keep = s != 0
            if keep.any():
                keep[1:] |= keep[:-1]  # one 0 after each run of letters
                parts.append(s[keep])
                n += len(parts[-1])
        ends[k] = n
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint16)), ends


def ngrams(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each symbol the 4-gram that ends with it, 15 bits a symbol; 0 stands before a text."""
    starts = np.concatenate([[0], ends[:-1]])
    out = s.astype(np.uint64)
    for k in range(1, ORDER):
        back = np.zeros(len(s), np.uint64)
        back[k:] = s[:-k]
        for t in range(k):
            at = starts + t
            back[at[at < ends]] = 0
        out |= back << np.uint64(WIDTH * k)
    return out


def merge_counts(a: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if a is None:
        return keys, counts
    both, inverse = np.unique(np.concatenate([a[0], keys]), return_inverse=True)
    return both, np.bincount(inverse, weights=np.concatenate([a[1], counts]), minlength=len(both)).astype(np.int64)


def count_ngrams(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's texts, summed over the task as far as ``most`` entries allow."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in held.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "gram": common.signed(keys), "n": counts})
        held.clear()

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            s, ends = encode([t for g, t in zip(langs, texts, strict=True) if g == lang])
            if len(s):
                held[lang] = merge_counts(held.get(lang), *np.unique(ngrams(s, ends), return_counts=True))
        if sum(len(k) for k, _ in held.values()) > most:
            yield from flush()
    yield from flush()


class Hashed:
    """Rows of float32 by 64-bit key, sorted by the key's hash; a directory of its first bits gives a range of a few entries."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        h = keys.astype(np.uint64) * MIX
        order = np.argsort(h, kind="stable")
        self.hashes, self.rows = h[order], rows[order].astype(np.float32)
        self.bits = max(1, int(math.ceil(math.log2(len(keys) + 1))) + 1)
        slots = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(slots, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is absent."""
        h = keys * MIX
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        out = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            p = at[todo]
            same = self.hashes[p] == h[todo]
            out[todo[same]] = p[same]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


class Share:
    """Resolved log2 probabilities, a column for each language, of the n-grams whose last letter but one falls into a share."""

    def __init__(self, orders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], discounts: dict[tuple[int, int], float], langs: int, alphabet: int, share: int = 0, shares: int = 1) -> None:
        """orders: order -> numbers of the languages, n-grams and their counts. discounts: by language and order."""
        self.langs, self.alphabet, self.share, self.shares = langs, alphabet, share, shares
        self.tables: dict[int, Hashed] = {}
        self.backs: dict[int, Hashed] = {}
        for o in range(1, ORDER + 1):
            owner, keys, counts = orders[o]
            union = np.unique(keys)
            contexts = np.unique(union >> np.uint64(WIDTH))
            of = np.searchsorted(contexts, union >> np.uint64(WIDTH))
            rows, backs = 2.0 ** self._logs(union & np.uint64((1 << WIDTH * (o - 1)) - 1), o - 1), np.zeros((len(contexts), langs), np.float32)
            for j in range(langs):
                mine = owner == j
                k, c, d = keys[mine], counts[mine].astype(np.float64), discounts.get((j, o), 0.5)
                ctx = np.searchsorted(contexts, k >> np.uint64(WIDTH))
                total = np.bincount(ctx, weights=c, minlength=len(contexts))
                back = np.where(total > 0, d * np.bincount(ctx, minlength=len(contexts)) / np.maximum(total, 1), 1.0)
                rows[:, j] *= back[of]
                rows[np.searchsorted(union, k), j] += np.maximum(c - d, 0) / total[ctx]
                backs[:, j] = np.log2(back)
            self.tables[o], self.backs[o] = Hashed(union, np.log2(np.maximum(rows, 1e-12))), Hashed(contexts, backs)

    def _logs(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log2 probabilities of each key's last symbol after the rest of it, a column for each language."""
        if order == 0:
            return np.full((len(keys), self.langs), -math.log2(self.alphabet), np.float32)
        at = self.tables[order].find(keys)
        out = self.tables[order].rows[at] if len(self.tables[order].rows) else np.zeros((len(keys), self.langs), np.float32)
        if len(miss := np.flatnonzero(at < 0)):
            low = self._logs(keys[miss] & np.uint64((1 << WIDTH * (order - 1)) - 1), order - 1)
            back = self.backs[order].find(keys[miss] >> np.uint64(WIDTH))
            if len(known := np.flatnonzero(back >= 0)):
                low[known] += self.backs[order].rows[back[known]]
            out[miss] = low
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the share's positions, a column for each language, and the number of symbols of each text."""
        bits, sizes = np.zeros((len(texts), self.langs)), np.zeros(len(texts), np.int64)
        for a, b in blocks(texts):
            s, ends = encode(texts[a:b])
            sizes[a:b] = n = np.diff(ends, prepend=0)
            owner, grams = np.repeat(np.arange(a, b), n), ngrams(s, ends)
            for at in range(0, len(grams), BLOCK):  # a very long text in pieces
                g, mine = grams[at : at + BLOCK], owner[at : at + BLOCK]
                if self.shares > 1:
                    own = share_of(g, self.shares) == self.share
                    g, mine = g[own], mine[own]
                if len(g) and self.langs:
                    logs, starts = self._logs(g, ORDER), np.flatnonzero(np.diff(mine, prepend=-1))
                    bits[mine[starts]] -= np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
        return bits, sizes


#: Characters that are scored at once.
BLOCK = 1 << 16


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` characters."""
    a, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= BLOCK:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def share_of(grams: np.ndarray, shares: int) -> np.ndarray:
    """By the last letter but one: that of the last letter's nearest context."""
    return ((grams >> np.uint64(WIDTH)) & np.uint64(FIELD)) % np.uint64(shares)


def decide(langs: list[str], limits: dict[str, tuple[float, float]], sums: np.ndarray, sizes: np.ndarray) -> list[tuple[str, float, float, bool]]:
    """(language, score, bits per symbol, rejected) of each text."""
    out = []
    for row, n in zip(sums, sizes.tolist(), strict=True):
        if not n or not langs:
            out.append(("und", 0.0, 0.0, True))
            continue
        row = row / n
        best = int(np.argmin(row))
        score = 1.0 / np.exp2(np.maximum(-(row - row[best]) * min(n, EVIDENCE), -1000)).sum()
        mean, spread = limits.get(langs[best], (math.inf, 0.0))
        out.append((langs[best], float(score), float(row[best]), bool(row[best] > mean + spread * (1 + EVIDENCE / n))))
    return out


PREDICTED = "lang string, score double, bits double, rejected boolean"
_PREDICTED = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("rejected", pa.bool_())])


class Model:
    """The languages' models: n-grams of all orders in a table, read share by share."""

    def __init__(self, spark: SparkSession, scratch: common.Scratch, orders: DataFrame, langs: list[str], discounts: dict[tuple[int, int], float], alphabet: int, shares: int) -> None:
        self.spark, self.scratch, self.orders, self.langs = spark, scratch, orders, langs
        self.discounts, self.alphabet, self.shares = discounts, alphabet, shares
        self.limits: dict[str, tuple[float, float]] = {}
        self.broadcasts: dict[int, Broadcast] = {}

    def _share(self, k: int) -> Broadcast:
        """One share at a time is on the executors."""
        if k not in self.broadcasts:
            self.release()
            mine = (F.col("o") == 1) | (F.pmod(F.shiftright("gram", WIDTH).bitwiseAND(F.lit(FIELD)), F.lit(self.shares)) == k)
            rows = self.orders.filter(mine).toArrow()
            order, owner = rows["o"].to_numpy(), rows["owner"].to_numpy()
            grams, n = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
            held = {o: (owner[order == o], grams[order == o], n[order == o]) for o in range(1, ORDER + 1)}
            self.broadcasts[k] = self.spark.sparkContext.broadcast(Share(held, self.discounts, len(self.langs), self.alphabet, k, self.shares))
        return self.broadcasts[k]

    def release(self) -> None:
        for b in self.broadcasts.values():
            b.destroy()
        self.broadcasts.clear()

    def score(self, rows: DataFrame, text: str = "text", into: str = "__p") -> DataFrame:
        """Rows with a struct of lang, score, bits (per symbol) and rejected."""
        langs, limits, column = self.langs, dict(self.limits), F.col(f"`{text}`")
        if self.shares == 1:
            share = self._share(0)

            def whole(texts: pa.Array) -> pa.Array:
                return pa.array(decide(langs, limits, *share.value.sums(texts.to_pylist())), _PREDICTED)

            return rows.withColumn(into, common.arrow_udf("langid", whole, PREDICTED)(column))
        run = uuid.uuid4().hex
        for k in range(self.shares):
            part = self._share(k)

            def some(texts: pa.Array, before: pa.Array, part: Broadcast = part) -> pa.Array:
                sums, sizes = part.value.sums(texts.to_pylist())
                sums = [b if s is None else (np.array(s["sums"]) + b) for s, b in zip(before.to_pylist(), sums, strict=True)]
                return pa.array([{"sums": s.tolist(), "size": n} for s, n in zip(sums, sizes.tolist(), strict=True)], pa.struct([("sums", pa.list_(pa.float64())), ("size", pa.int64())]))

            held = F.col(into) if k else F.lit(None).cast("struct<sums:array<double>,size:long>")
            rows = self.scratch.save(rows.withColumn(into, common.arrow_udf("langid", some, "sums array<double>, size long")(column, held)), f"{into}{k}-{run}")
            if k:  # one pass's table at a time is left
                self.scratch.drop(f"{into}{k - 1}-{run}")

        def last(sums: pa.Array) -> pa.Array:
            held = sums.to_pylist()
            return pa.array(decide(langs, limits, np.array([s["sums"] for s in held]), np.array([s["size"] for s in held])), _PREDICTED)

        return rows.withColumn(into, common.arrow_udf("langid", last, PREDICTED)(F.col(into)))


#: Standard deviations above a language's mean entropy beyond which a text is rejected.
REJECT = 10.0


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", max_cells: int = 12_000_000) -> Model:
    """A model from labelled texts: every n-gram of every one of them, in shares of at most about ``max_cells``
    probabilities. Rejection is calibrated on all different texts of each language."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    scratch = common.Scratch(spark, "langid")
    counted = common.arrow_stream("langid", rows, count_ngrams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.save(counted, "counts")
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").toLocalIterator()]
    owner = (F.array_position(F.lit(langs) if langs else F.array().cast("array<string>"), F.col("lang")) - 1).cast("int")
    orders = counts.select(F.lit(ORDER).alias("o"), owner.alias("owner"), "gram", "n")
    lower = orders
    for o in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols stand before a shorter gram
        lower = lower.groupBy("owner", F.col("gram").bitwiseAND(F.lit((1 << WIDTH * o) - 1)).alias("gram")).agg(F.count("*").alias("n")).select(F.lit(o).alias("o"), "owner", "gram", "n")
        lower = scratch.save(lower, f"order{o}")
        orders = orders.unionByName(lower)
    few = F.col("n") == 1, F.col("n") == 2
    kinds = orders.groupBy("o", "owner").agg(F.count("*").alias("kinds"), *[F.sum(c.cast("long")).alias(k) for c, k in zip(few, ("ones", "twos"), strict=True)]).collect()  # four rows a language
    discounts = {(r.owner, r.o): min(0.9, max(0.1, r.ones / max(1, r.ones + 2 * r.twos))) for r in kinds}
    alphabet = max(2, lower.select("gram").distinct().count() + 1)
    shares = max(1, -(-sum(r.kinds for r in kinds) * len(langs) // max_cells))
    model = Model(spark, scratch, orders, langs, discounts, alphabet, shares)
    if langs:
        mark, right = F.struct(F.xxhash64("text"), F.crc32("text"), F.length("text")), F.when(F.col("__p.lang") == F.col("lang"), F.col("__p.bits"))
        each = model.score(rows).groupBy("lang", mark.alias("mark")).agg(F.max(right).alias("bits"))  # equal texts, equal bits: a text counts once, and only its marks move
        limits = each.groupBy("lang").agg(F.avg("bits").alias("mean"), F.stddev_pop("bits").alias("spread")).filter("mean IS NOT NULL").collect()
        model.limits = {r.lang: (r.mean, REJECT * max(r.spread, 0.05)) for r in limits}
    if shares == 1:  # all there is has been broadcast
        model._share(0)
        scratch.close()
    return model


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.filter(common.crc32_mod3() != 1)


def predicted(documents: DataFrame, **options) -> DataFrame:
    """Documents with a struct ``__p`` of the prediction, learned from those that are not held out."""
    return train(training_rows(documents), **options).score(documents)


@common.shielded
def identify(documents: DataFrame, **options) -> DataFrame:
    """Documents with held_out, lang_pred, score, bits (per symbol) and rejected; columns of these names are replaced."""
    p: Column = F.col("__p")
    results = {"held_out": common.crc32_mod3() == 1, "lang_pred": p["lang"], "score": p["score"], "bits": p["bits"], "rejected": p["rejected"]}
    return predicted(documents, **options).select(*common.columns(documents, but=list(results)), *[c.alias(n) for n, c in results.items()])


@common.shielded
def accepted(documents: DataFrame, **options) -> DataFrame:
    """Documents that are in some learned language, with the columns they had."""
    return predicted(documents, **options).filter("NOT __p.rejected").select(*common.columns(documents))


def op2_langid(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return identify(documents.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "bits", "rejected")
