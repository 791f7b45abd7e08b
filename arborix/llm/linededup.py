"""Line dedup over levelled sorted runs of line hashes.

The index is a family of runs. A run holds, sorted and bucketed by hash, one
entry for each line key of the batches it covers: in how many documents the key
occurs and the largest doc_id that holds it. A new batch's keys are merge-anti-
joined with each run's settled entries (a key in enough documents, kept by a
document at least as large, can change no more); the others become a run of
level 0. Once a level has ``fan_out`` runs they are compacted into one run of
the next level. Runs are bucketed tables, so that a join or a compaction sorts
and shuffles the new batch only.

A key is 128 bits of a hash. Defined cases: null and empty texts are one empty
line; keys shorter than ``least`` code points are never dropped; a key counts
once for each doc_id; rows of one doc_id are one document to the counts, and
keep or lose the same keys; null doc_ids count as one document, the smallest;
an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .runs import Runs


def line_keys(text: bytes | None, least: int) -> list[bytes]:
    """Each line's key, empty where it is shorter than ``least`` code points."""
    return [k if len(k) >= least and (len(k) >= 4 * least or len(k.decode("utf-8", "replace")) >= least) else b"" for k in [line.strip().lower() for line in (text or b"").split(b"\n")]]


def digest(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def hashes_of(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, h1, h2): the different keys of each row of (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        docs, found = [], []
        for doc, text in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), strict=True):
            new = set(line_keys(text, least)) - {b""}
            docs += [doc] * len(new)
            found += map(digest, new)
        if not docs:
            return None
        h = np.array(found, np.uint64)
        return pa.record_batch([pa.array(docs, pa.int64()), common.signed(h[:, 0]), common.signed(h[:, 1])], names=["doc_id", "h1", "h2"])

    return common.arrow_map("lines", documents.select("doc_id", "text"), run, "doc_id long, h1 long, h2 long")


class LineIndex:
    """Levelled runs of line hashes; ``threshold`` documents make a key one that is dropped."""

    def __init__(self, spark: SparkSession, *, threshold: int = 3, least: int = 20, fan_out: int = 2, buckets: int | None = None) -> None:
        self.spark, self.threshold, self.least = spark, threshold, least
        # runs are of different batches: a key's documents are those of all of them
        self.runs = Runs(spark, "line_run", ["h1", "h2"], {"n": "sum", "keeper": "max"}, fan_out=fan_out, buckets=buckets)

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of documents (doc_id, text)."""
        held = hashes_of(batch, self.least).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
        entries = held.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        for run in self.runs.names():
            settled = self.spark.table(run).filter(F.col("n") >= self.threshold)
            on = (entries["h1"] == settled["h1"]) & (entries["h2"] == settled["h2"]) & (entries["keeper"] <= settled["keeper"])
            entries = entries.join(settled, on, "left_anti")
        self.runs.add(entries)

    def dropped(self) -> DataFrame:
        """(h1, h2, keeper) of the keys found in enough documents."""
        return self.runs.merged().filter(F.col("n") >= self.threshold).select("h1", "h2", "keeper")

    def close(self) -> None:
        self.runs.close()


def strip_lines(documents: DataFrame, least: int, text: str = "text") -> DataFrame:
    """Documents, with a column ``__lose`` of dropped hashes, to n_lines, n_dropped and the text that is left."""

    def run(texts: pa.Array, lose: pa.Array) -> pa.Array:
        rows = []
        for t, drop in zip(common.utf8(texts), lose.to_pylist(), strict=True):
            lines, n = (t or b"").split(b"\n"), 0
            if drop:
                gone = set(drop)
                kept = [line for line, key in zip(lines, line_keys(t, least), strict=True) if not key or xxhash.xxh3_128_digest(key) not in gone]
                n, t = len(lines) - len(kept), b"\n".join(kept)
            rows.append((len(lines), n, None if t is None else t.decode("utf-8", "replace")))
        return pa.array(rows, pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())]))

    s = common.arrow_udf("lines", run, "n_lines long, n_dropped long, kept string")(F.col(f"`{text}`"), F.col("__lose"))
    return documents.withColumn("__s", s).withColumns({k: F.col(f"__s.{k}") for k in ("n_lines", "n_dropped", "kept")}).drop("__s", "__lose")


def binary128() -> Column:
    return F.unhex(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))


@common.shielded
def dedup_lines(documents: DataFrame, *, threshold: int = 3, least: int = 20, batches: int = 3, fan_out: int = 2) -> DataFrame:
    """Documents with n_lines, n_dropped and kept (the text without lines that a larger doc_id keeps).

    The documents enter the index in ``batches`` of falling doc_id, so that a
    settled key's keeper is final and later batches need not carry it.
    """
    spark = documents.sparkSession
    scratch, index = common.Scratch(spark, "lines"), LineIndex(spark, threshold=threshold, least=least, fan_out=fan_out, buckets=common.partitions(documents))
    rows = documents.select("doc_id", "text")
    try:
        cuts = documents.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
        cuts = sorted(set(cuts), reverse=True)
        for k in range(len(cuts) + 1):
            part = rows.filter(F.col("doc_id") > cuts[k]) if k < len(cuts) else rows
            part = part.filter(F.col("doc_id") <= cuts[k - 1]) if k and k < len(cuts) else part.filter((F.col("doc_id") <= cuts[k - 1]) | F.col("doc_id").isNull()) if k else part
            index.add(part)
        drop = scratch.save(index.dropped(), "drop")  # a table: a join of two exchanges can split a frequent line's rows
        lines = hashes_of(rows, least)
        lost = lines.join(drop, ["h1", "h2"]).filter(F.coalesce("doc_id", F.lit(-(1 << 63))) < F.col("keeper"))
        per_doc = scratch.keep(lost.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(binary128()).alias("__lose")))
    finally:
        index.close()
        scratch.close()
    # the same join at every size: what it moves then grows as the documents do
    joined = documents.join(per_doc.hint("merge"), documents["doc_id"].eqNullSafe(per_doc["__id"]), "left").drop("__id")
    return strip_lines(joined, least)


def op5_line_dedup(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return dedup_lines(documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def brute_force(documents: list[tuple[int, str | None]], threshold: int = 3, least: int = 20) -> dict[int, tuple]:
    """A dictionary of all keys, for tests."""
    held: dict[bytes, set[int]] = {}
    for doc, text in documents:
        for key in line_keys(text.encode() if text else None, least):
            if key:
                held.setdefault(key, set()).add(doc)
    out = {}
    for doc, text in documents:
        lines = (text or "").encode().split(b"\n")
        kept = [x for x, k in zip(lines, line_keys(text.encode() if text else None, least), strict=True) if not k or len(held[k]) < threshold or doc == max(held[k])]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())
    return out


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, r.keeper IS NOT NULL AND k.doc_id < r.keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
