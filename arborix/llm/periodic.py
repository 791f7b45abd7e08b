r"""Periodic runs of words by harmonic grid probing.

A run with period p and at least four periods holds four grid points jp, (j+1)p,
..., whose words are equal, so for each p only the words of the grid are
compared with their successors, n / p of them: over all p a text of n words
takes n log n comparisons. Small periods are probed one by one, each a strided
comparison; for large ones, one comparison for each j covers all periods. Where
three comparisons in a row hold, the equality of words p apart is followed to
both sides by comparing chunks of the arrays, each twice as long as the last.

Periods rise, so what is found first has the smallest period: grid points
inside a known run of a period that divides p are skipped, and only runs that
are long enough to hold such points are looked at.

Words are ``[^\x20\x09-\x0D]+``; a run is a stretch of at least ``min_words``
words and ``min_periods`` (4 or more) of its smallest period that no neighbour extends.

Memory is a few numbers for each word of a batch's texts; a worker holds nothing between texts.

Defined cases: null and empty texts and texts of blanks have no words, no runs
and the empty text as their collapsed form; a text of one word repeated is one
run; repeated rows are separate and equal; a null doc_id counts as the empty
string where a digest is taken; an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS, MIN_PERIODS = 6, 4
BLANKS = r"[\x20\x09-\x0D]+"
#: Words of the first chunk that is compared.
CHUNK = 64


def numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal where the words are."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def reach(w: np.ndarray, p: int, at: int, step: int) -> int:
    """How many places from ``at`` on, in steps of 1 or -1, hold a word equal to the one p further."""
    limit, n, chunk = (len(w) - p - at) if step > 0 else at + 1, 0, CHUNK
    while n < limit:
        size = min(chunk, limit - n)
        a = at + n if step > 0 else at - n - size + 1
        differ = w[a : a + size] != w[a + p : a + p + size]
        if step < 0:
            differ = differ[::-1]
        if (k := int(differ.argmax())) or differ[0]:
            return n + k
        n, chunk = n + size, 2 * chunk
    return n


def periods_to_probe(w: np.ndarray, last: int) -> np.ndarray:
    """The periods up to ``last`` of which some three grid points in a row equal their successors."""
    n, small = len(w), min(last, int(len(w) ** 0.5) + 1)
    some = np.zeros(last + 1, bool)
    for p in range(1, small + 1):
        e = w[: n - p : p] == w[p::p]
        some[p] = len(e) > 2 and bool((e[:-2] & e[1:-1] & e[2:]).any())
    if last > small:
        p = np.arange(small + 1, last + 1)
        before, now = np.zeros(len(p), bool), np.zeros(len(p), bool)  # of the two grid points before
        for j in range(n // (small + 1)):
            inside = int(np.searchsorted(p, (n - 1) // (j + 1), "right"))  # (j + 1) p is a word
            if not inside:
                break
            equal = w[j * p[:inside]] == w[(j + 1) * p[:inside]]
            some[p[:inside][before[:inside] & now[:inside] & equal]] = True
            before, now = now[:inside], equal
    return np.flatnonzero(some)


def find_runs(w: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """(start, length, period) of every run, by start, then period."""
    n, found = len(w), []
    active = np.zeros((0, 3), np.int64)  # runs long enough to hold grid points of a period to come, by start
    if n < min_words:
        return np.zeros((0, 3), np.int64)
    for p in periods_to_probe(w, n // min_periods).tolist():
        e = w[: n - p : p] == w[p::p]
        hits = np.flatnonzero(e[:-2] & e[1:-1] & e[2:]) * p
        active = active[active[:, 1] > 3 * p]
        known = active[p % active[:, 2] == 0]
        if len(known):  # the furthest end of those that begin at or before a place is one run's
            ends = np.maximum.accumulate(known[:, 0] + known[:, 1])
            k = np.searchsorted(known[:, 0], hits, "right")
            hits = hits[(k == 0) | (ends[np.maximum(k, 1) - 1] <= hits + 3 * p)]
        upto, new = -1, []
        for at in hits.tolist():
            if at < upto:  # within the run just seen
                continue
            start, size = at - reach(w, p, at - 1, -1) if at else 0, reach(w, p, at, 1)
            upto, length = at + size, at + size + p - start
            # a stretch with a smaller period is a known run, whole
            if length >= max(min_words, min_periods * p) and not (len(known) and ((known[:, 0] <= start) & (known[:, 0] + known[:, 1] >= start + length)).any()):
                new.append((start, length, p))
        if new:
            found += new
            active = np.concatenate([active, np.array(new, np.int64)])
            active = active[np.argsort(active[:, 0], kind="stable")]
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic(text: Column, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> Column:
    """(n_words, runs, collapsed) of a text; the collapsed text's words stand one blank apart."""
    if min_periods < 4 or min_words < 1:
        raise ValueError("four periods at least: shorter runs may hold too few grid points")

    def run(texts: pa.Array) -> pa.Array:
        counts, rows, cut, ends = [], [], [], [0]
        for t in common.utf8(texts):
            words = (t or b"").split()
            runs = find_runs(numbers(words), min_words, min_periods)
            if len(runs):
                words_left = [words[k] for k in np.flatnonzero(kept(len(words), runs)).tolist()]
            counts.append(len(words))
            cut.append(b" ".join(words_left if len(runs) else words))
            rows.append(runs)
            ends.append(ends[-1] + len(runs))
        columns = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(columns[:, k])) for k in range(3)], ["start", "length", "period"])
        text_out = pa.array(cut, pa.binary()).cast(pa.string(), safe=False)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), text_out], ["n_words", "runs", "collapsed"])

    return common.arrow_udf("periodic", run, FOUND)(text)


@common.shielded
def with_runs(documents: DataFrame, *, text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Documents with n_words, runs (start, length, period, in words) and collapsed, the text without what repeats; columns of these names are replaced."""
    found = documents.withColumn("__p", periodic(F.col(f"`{text}`"), min_words, min_periods))
    names = ("n_words", "runs", "collapsed")
    return found.select(*common.columns(documents, but=names), *[F.col(f"__p.{c}").alias(c) for c in names])


def collapse(documents: DataFrame, *, text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Documents whose texts' runs are cut to their first period; texts without a run stay as they are, blanks and all."""
    found = documents.withColumn("__p", periodic(F.col(f"`{text}`"), min_words, min_periods))
    return found.withColumn(text, F.when(F.size("__p.runs") > 0, F.col("__p.collapsed")).otherwise(F.col(f"`{text}`"))).drop("__p")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """Documents whose ``text`` is periodic from some word on where crc32(doc_id) is divisible by ten."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BLANKS), lambda w: w != "")
    chosen = documents.withColumns({"__h": h, "__w": F.when(h % 10 == 0, words)})  # null: the text stays
    g, n = F.floor(F.col("__h") / 10), F.size("__w").cast("long")
    placed = chosen.withColumns({"__n": n, "__g": g}).withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    placed = placed.withColumn("__per", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)))
    a, per, left = F.col("__a").cast("int"), F.col("__per").cast("int"), (F.col("__n") - F.col("__a")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__w", a + 1, per), F.ceil(left / per).cast("int"))), F.lit(1), left)
    text = F.when(F.col("__n") > 0, F.array_join(F.concat(F.slice("__w", F.lit(1), a), tail), " ")).otherwise(F.col("text"))
    return placed.withColumn("text", text).drop("__h", "__w", "__n", "__g", "__a", "__per")


def op12_periodic(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    found = with_runs(with_planted_runs(documents.select("doc_id", "text")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    key = lambda r: F.struct(-r["length"], r["start"].alias("start"), r["period"].alias("period"))
    best = F.array_min(F.transform("runs", key))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    longest = out.withColumns({"start": F.col("b.start"), "length": -F.col("b.col1"), "period": F.col("b.period")})
    exponent = F.floor(1000 * F.col("length") / F.col("period")).cast("long")
    return longest.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words, for tests."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Every run by its definition, period by period, for tests."""
    out, n = set(), len(words)
    for p in range(1, n // MIN_PERIODS + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            length = e + p - s
            if length >= max(MIN_WORDS, MIN_PERIODS * p) and not any(all(words[k] == words[k + q] for k in range(s, s + length - q)) for q in range(1, p)):
                out.add((s, length, p))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_force(doc_id: int | None, text: str | None) -> tuple:
    """One document's row, for tests."""
    words = planted(doc_id, (text or "").encode().split())
    runs = brute_runs(words)
    drop = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    numbers_ = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *numbers_, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop))
