"""BPE encoding and decoding by forced-boundary splitting.

A merge across a place in a text makes a token that holds the two bytes beside
it. Where a pair of bytes stands inside no token of the vocabulary, no merge can
cross: the place is a certain cut. A table of 65,536 pairs, built once from the
vocabulary, gives the cuts of a whole text in one look-up for each byte, and the
fragments between them are encoded on their own and put together again. Most
fragments are words and come from a worker's memory.

The tokenizer splits a text by a pattern before it merges, and a cut must not
change what the pattern sees. Behind white space it looks ahead, and at an
apostrophe it looks for contractions, so there is no cut at these places; all
other runs of the pattern are of one kind of character, and a part of a run is
split as the run was. Cuts stand between characters, never inside one.

Memory: a fragment is remembered only up to ``REMEMBER`` bytes, and at most
``GENERATION`` of them in each of two generations, so a worker's memory has a bound
whatever the texts are (about 100 MB). Other work is linear in a text's bytes.

Defined cases: null and empty texts have no ids and decode to the empty text;
special tokens in a text are what the library's plain call makes of them; ids
that the vocabulary lacks decode to nothing, and bytes that are no UTF-8 to
U+FFFD; null ids decode to null; equal texts have equal ids; an empty table
gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokenbin import byte_letters, vocabulary_path

#: Bytes of the longest fragment that is remembered, and fragments in each of two generations.
REMEMBER, GENERATION = 64, 200_000
#: Patterns may count these as white space, or did in older versions of Unicode.
BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() or c in "᠎​"]


def token_bytes(tokenizer) -> dict[int, bytes]:
    """The bytes that each id stands for."""
    byte_of = {letter: byte for byte, letter in byte_letters().items()}
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    spelt = {i: token for token, i in tokenizer.get_vocab(with_added_tokens=False).items()} | added
    return {i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for i, token in spelt.items()}


def certain_cuts(tokens: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables over pairs of bytes: where a text may be cut between the two, and after which two it may not, since they end a wide blank."""
    cut = np.ones((256, 256), bool)
    whole = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    inside = np.ones(max(0, len(whole) - 1), bool)
    inside[ends[:-1] - 1] = False  # from one token's last byte to the next one's first
    cut[whole[:-1][inside], whole[1:][inside]] = False
    cut[[ord(c) for c in BLANKS if ord(c) < 128], :] = False
    cut[:, ord("'")] = False
    cut[:, 0x80:0xC0] = False  # inside a character
    wide = np.zeros((256, 256), bool)
    for tail in {c.encode()[-2:] for c in BLANKS if ord(c) >= 128}:
        wide[tail[0], tail[1]] = True
    return cut.ravel(), wide.ravel()


class Codec(dict):
    """A byte-level BPE; the dictionary is the young generation of its memory, fragment -> ids as bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = token_bytes(self.tokenizer)
        self.dtype = np.dtype("<u2" if max(self.tokens) < 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content.encode(): np.array([i], self.dtype).tobytes() for i, t in added.items()}
        self.at_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.cut, self.wide = certain_cuts([t for i, t in self.tokens.items() if i not in added])
        self.old: dict[bytes, bytes] = {}
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # of arrays of that width

    def fragments(self, data: bytes) -> list[bytes]:
        """A text without special tokens, cut wherever that is certain."""
        if len(data) < 2:
            return [data] if data else []
        b = np.frombuffer(data, np.uint8)
        pairs = b[:-1].astype(np.uint16) << 8 | b[1:]
        at = np.flatnonzero(self.cut[pairs])
        at = at[~self.wide[pairs[np.maximum(at, 1) - 1]] | (at == 0)] + 1
        ends = [0, *at.tolist(), len(data)]
        return [data[x:y] for x, y in zip(ends, ends[1:])]  # noqa: B905

    def _new(self, fragment: bytes) -> bytes:
        """The library's ids of a fragment. Letters alone, behind a blank or not, are one piece for the pattern and go straight to the merges."""
        text = fragment.decode("utf-8", "replace")
        letters = text[1:] if text[0] == " " else text
        if letters.isalpha() and (letters.isascii() or max(letters) < "⺀"):  # the pattern's letters, to there, are Python's
            ids = [t.id for t in self.model.tokenize(fragment.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def __missing__(self, fragment: bytes) -> bytes:
        if (out := self.old.get(fragment)) is None:
            out = self._new(fragment)
        if len(fragment) <= REMEMBER:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[fragment] = out
        return out

    def encode(self, data: bytes | None) -> bytes:
        """A whole text's ids, as bytes."""
        if not data:
            return b""
        if self.at_special is None or not self.at_special.search(data):
            return b"".join(map(self.__getitem__, self.fragments(data)))
        parts = self.at_special.split(data)  # text and special tokens by turns
        return b"".join(self.special[p] if k % 2 else b"".join(map(self.__getitem__, self.fragments(p))) for k, p in enumerate(parts))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The text of ids, in UTF-8."""
        data = b"".join([self.tokens.get(i, b"") for i in ids])
        return data.decode("utf-8", "replace").encode()


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


common.held("bpe", codec.cache_clear)


def _encoded(path: str, texts: pa.Array) -> pa.Array:
    """The texts' ids as lists; what is null has none."""
    c = codec(path)
    rows = list(map(c.encode, common.utf8(texts)))
    ends = np.cumsum([0, *map(len, rows)]) // c.dtype.itemsize
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), c.dtype).astype(np.int32)))


def _decoded(path: str, ids: pa.Array) -> pa.Array:
    """The texts of lists of ids."""
    c = codec(path)
    return pa.array([None if row is None else c.decode(row).decode() for row in ids.to_pylist()], pa.string())


def encode(text: Column, vocabulary: str | None = None) -> Column:
    """The ids of a text, as ``array<int>``."""
    path = vocabulary or vocabulary_path()

    def run(texts: pa.Array) -> pa.Array:
        return _encoded(path, texts)

    return common.arrow_udf("bpe", run, "array<int>")(text)


def decode(ids: Column, vocabulary: str | None = None) -> Column:
    """The text of ids."""
    path = vocabulary or vocabulary_path()

    def run(rows: pa.Array) -> pa.Array:
        return _decoded(path, rows)

    return common.arrow_udf("bpe", run, "string")(ids)


def encode_decode(text: Column, vocabulary: str | None = None) -> Column:
    """(ids, decoded) of a text, in one pass through a worker."""
    path = vocabulary or vocabulary_path()

    def run(texts: pa.Array) -> pa.Array:
        ids = _encoded(path, texts)
        return pa.StructArray.from_arrays([ids, _decoded(path, ids)], ["ids", "decoded"])

    return common.arrow_udf("bpe", run, "ids array<int>, decoded string")(text)


@common.shielded
def encoded(documents: DataFrame, *, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Documents with ``ids``."""
    return documents.withColumn("ids", encode(F.col(f"`{text}`"), vocabulary))


@common.shielded
def decoded(documents: DataFrame, *, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Documents with ``decoded``, the text of their ids."""
    return documents.withColumn("decoded", decode(F.col(f"`{ids}`"), vocabulary))


def op13_bpe(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    both = documents.select("doc_id", encode_decode(F.col("text")).alias("b")).select("doc_id", "b.ids", "b.decoded")
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def brute_force(text: str | None) -> tuple[int, str, str]:
    """The library's plain calls, for tests."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))
