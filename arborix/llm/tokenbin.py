"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, memory-mapped.

Documents are dealt to partitions by ranges of ``doc_id`` and sorted within
them. A task encodes its documents and writes, in files of at most
``file_tokens`` ids, the ids (``.bin``, unsigned 16 bits where the vocabulary
allows, else 32) and the index (``.idx``: document ids and offsets, 64 bits
each). Files carry a random name, and a task reports them only when it is
done: what a lost or repeated task leaves behind is in no manifest. Prefix sums
over the manifest, one row a file, give each file's base, and thereby every
document's place in the whole.

Defined cases: null and empty texts consist of the end id alone; special tokens
in a text are what the library's plain call makes of them; repeated doc_ids stand next to each other, in
the order of their texts' hashes; an empty table gives an empty manifest. Null
doc_ids come first; other columns are left out.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Null doc_ids in an index.
NO_ID = -(1 << 63)
#: Words that a worker remembers in each of two generations, and the longest of them: about 170 MB at most, whatever the texts.
GENERATION, LONGEST = 250_000, 32


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}


#: Letters and digits, and marks behind them that no contraction begins with.
TAIL = re.compile(r"([^\W_]+)([^\w\s']+)")


class Irregular(ValueError):
    """A text that may not be cut at its blanks."""


class Encoder(dict):
    """A byte-level BPE from the tokenizers library, with a memory: word -> ids, as bytes, of the word after a blank.

    A blank between two characters that are not white space begins a pre-token in any case, so the ids of a regular
    text (its blanks all stand so) are those of its words, one after the other. Words of letters only are one pre-token
    and go straight to the model; marks after a letter or digit, and a line feed inside a word, are cut off as pre-tokens
    of their own; all else takes the whole way, as do texts that are not regular or hold a special token.

    The memory has two generations: what is asked for moves to the young one, and when that is full it becomes the old
    one and the words that were not asked for since are forgotten. Keys that begin with a blank stand for words that
    have none before them.
    """

    def __init__(self, path: str, dtype: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.code = "H" if np.dtype(dtype).itemsize == 2 else "I"  # of arrays of that width
        self.marks, self.line = {c: self.whole(c) for c in ".,"}, self.whole("\n")

    def whole(self, text: str) -> bytes:
        """The library's plain call."""
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, word: str) -> bytes:
        plain = word.startswith(" ")
        letters = word[1:] if plain else word
        if letters.isalpha():
            if letters.isascii():
                spelt = letters if plain else "Ġ" + letters
            else:
                spelt = (letters if plain else " " + letters).encode().decode("latin-1").translate(self.letters)
            return array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if not letters or letters[0].isspace() or letters[-1].isspace():
            raise Irregular
        if tail := TAIL.fullmatch(letters):
            return self[word[: -len(tail[2])]] + self.mark(tail[2])
        return self.whole(letters if plain else " " + letters)

    def mark(self, marks: str) -> bytes:
        """The ids of a run of marks behind a letter or digit: a pre-token of its own."""
        if (out := self.marks.get(marks)) is None:
            out = self.whole(marks)
            if len(marks) < 8 and len(self.marks) < 10_000:
                self.marks[marks] = out
        return out

    def __missing__(self, word: str) -> bytes:
        if (mark := self.marks.get(word[-1:])) is not None and word[-2:-1].isalnum():
            return self[word[:-1]] + mark  # parts are remembered, not the whole
        out = self.old.get(word)
        if out is None:
            if "\n" in word:
                first, *rest = word.split("\n")
                return self[first] + b"".join([self.line + self[" " + r] for r in rest])
            out = self._new(word)
        if len(word) <= LONGEST:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            first, *words = text.split(" ")
            try:
                return self[" " + first] + b"".join(map(self.__getitem__, words))
            except Irregular:
                pass
        return self.whole(text)


@lru_cache(maxsize=1)
def encoder(path: str, dtype: str) -> Encoder:
    return Encoder(path, dtype)


common.held("tokens", encoder.cache_clear)


@lru_cache(maxsize=8)
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, as executors see it: local and mounted folders, HDFS, object stores."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return fs, path


MANIFEST = "file string, first long, docs long, tokens long, size long"


def _writer(folder: str, path: str, dtype: str, end_id: int, file_tokens: int):
    """A task's documents (doc_id, text), in order -> files and their manifest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        enc, end, width = encoder(path, dtype), np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        ids, ends, out, n, name = [], [], None, 0, ""
        rows: list[tuple] = []

        def finish() -> None:
            nonlocal out, n
            out.close()
            with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                index.write(np.array(ids, "<i8").tobytes() + np.array([0, *ends], "<u8").tobytes())
            rows.append((name, ids[0], len(ids), n, n * width))
            out, n = None, 0
            ids.clear()
            ends.clear()

        for batch in batches:
            for doc, coded in zip(batch.column(0).to_pylist(), map(enc.encode, batch.column(1).to_pylist()), strict=True):
                if out is None:
                    name = uuid.uuid4().hex
                    out = fs.open_output_stream(f"{base}/{name}.bin", compression=None, buffer_size=1 << 20)
                piece = coded + end
                out.write(piece)
                n += len(piece) // width
                ids.append(NO_ID if doc is None else doc)
                ends.append(n)
                if n >= file_tokens:
                    finish()
        if out is not None:
            finish()
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "first", "docs", "tokens", "size"])

    return run


def write(documents: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, file_tokens: int = 8_000_000) -> DataFrame:
    """Writes the files into ``folder``; the manifest (also written there) gives each file its number, base and first document."""
    spark = documents.sparkSession
    path = vocabulary or vocabulary_path()
    dtype = "<u2" if max(vocabulary_size(path) - 1, end_id) < 1 << 16 else "<u4"
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = common.partitions(documents)
    ranged = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    written = common.arrow_stream("tokens", ranged.select("doc_id", "text"), _writer(folder, path, dtype, end_id, file_tokens), MANIFEST)
    numbered = written.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id(), "dtype": F.lit(dtype)})
    numbered.write.options(**common.WRITING).parquet(f"{folder}/files")  # once: the files exist from here on
    files = spark.read.parquet(f"{folder}/files")
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = files.withColumns({"number": F.row_number().over(Window.orderBy("at")) - 1, "base": F.coalesce(F.sum("tokens").over(before), F.lit(0))})
    based.select("number", "file", "first", "docs", "tokens", "size", "base", "dtype").coalesce(1).write.options(**common.WRITING).parquet(f"{folder}/manifest")
    known = {r.file for r in files.select("file").toLocalIterator()}
    for info in fs.get_file_info(pafs.FileSelector(base)):  # what lost and repeated tasks left behind
        if info.is_file and info.extension in ("bin", "idx") and info.base_name.partition(".")[0] not in known:
            fs.delete_file(info.path)
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, width: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, width, ids): every document read back from the files, ids as the stored little-endian bytes, or
    as such of ``width`` bytes each."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "base", "dtype", "docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for file, start, dtype, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stored = np.dtype(dtype).itemsize
                given = width or stored
                with fs.open_input_file(f"{base}/{file}.idx") as f:
                    index = f.read()
                ids, offsets = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "<u8", docs + 1, 8 * docs).astype(np.int64)
                with mapped(fs, f"{base}/{file}.bin") as f:
                    for a in range(0, docs, common.BATCH_ROWS):
                        cut = offsets[a : a + common.BATCH_ROWS + 1]
                        doc = pa.array(ids[a : a + common.BATCH_ROWS], mask=ids[a : a + common.BATCH_ROWS] == NO_ID)
                        f.seek(int(cut[0]) * stored)
                        held = memoryview(f.read(int(cut[-1] - cut[0]) * stored))
                        if given != stored:
                            held = memoryview(np.frombuffer(held, dtype).astype(f"<u{given}").tobytes())
                        at = ((cut - cut[0]) * given).tolist()
                        rows = pa.array([bytes(held[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                        yield pa.record_batch([doc, pa.array(start + cut[:-1]), pa.array(np.diff(cut)), pa.array([given] * len(rows), pa.int32()), rows], names=["doc_id", "start", "n_tokens", "width", "ids"])

    count = max(1, manifest.count())  # a file is a task: at most eight million ids
    return common.arrow_stream("tokens", manifest.repartition(count, "file"), run, "doc_id long, start long, n_tokens long, width int, ids binary")


def mapped(fs: pafs.FileSystem, path: str):
    """A file as memory where the file system is local or mounted, else as a stream with random access."""
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


class TokenFiles:
    """Random access for a trainer: the ids of the whole, memory-mapped file by file."""

    def __init__(self, folder: str) -> None:
        import pyarrow.parquet as pq

        fs, base = file_system(folder)
        rows = sorted(pq.read_table(f"{base}/manifest", filesystem=fs).to_pylist(), key=lambda r: r["number"])
        self.bases = np.array([r["base"] for r in rows] + [sum(r["tokens"] for r in rows)], np.int64)
        self.docs = np.cumsum([0, *(r["docs"] for r in rows)])
        self.parts = [np.memmap(f"{base}/{r['file']}.bin", r["dtype"], "r") for r in rows]
        index = [np.memmap(f"{base}/{r['file']}.idx", "<i8", "r") for r in rows]
        self.ids, self.offsets = [x[: r["docs"]] for x, r in zip(index, rows, strict=True)], [x[r["docs"] :] for x, r in zip(index, rows, strict=True)]

    def __len__(self) -> int:
        return int(self.docs[-1])

    def __getitem__(self, i: int) -> tuple[int, np.ndarray]:
        """(doc_id, ids) of the i-th document."""
        p = int(np.searchsorted(self.docs, i, "right")) - 1
        k = i - int(self.docs[p])
        return int(self.ids[p][k]), self.parts[p][int(self.offsets[p][k]) : int(self.offsets[p][k + 1])]

    def window(self, start: int, size: int) -> np.ndarray:
        """``size`` ids of the whole from ``start`` on."""
        out = []
        while size > 0 and start < self.bases[-1]:
            p = int(np.searchsorted(self.bases, start, "right")) - 1
            got = self.parts[p][start - int(self.bases[p]) :][:size]
            out.append(got)
            start, size = start + len(got), size - len(got)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def op3_token_binary(documents: DataFrame) -> DataFrame:
    """The contract's row for each document, from the files."""
    spark = documents.sparkSession
    folder = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents, folder)
    common.delete_on_exit(spark, folder)

    return read(spark, folder, width=4).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def brute_force(documents: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int]]:
    """Whole texts through the tokenizer, for tests."""
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(vocabulary_path()), 0, {}
    for doc, text in sorted(documents):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        out[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out
