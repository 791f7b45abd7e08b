"""Token counts by a linear longest-match automaton.

Greedy word-piece takes, again and again, the longest piece of the vocabulary
that begins what is left of a word. Instead of building pieces, the automaton
reads a word once: each state of the vocabulary's trie has a failure link to
the state of what remains after popping the pieces that are settled when no
child fits, and the precomputed number of those pieces. A transition that has
been resolved over failure links is kept, so every byte costs one step.

A word is a run of bytes other than blanks; its first piece begins with the
blank before it (as in byte-level vocabularies), the others do not. All single
bytes are pieces, so each word has a count.

Defined cases: null and empty texts and texts of blanks have no words and no
tokens; any bytes are counted, whole; repeated rows get equal counts; an empty
table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words whose count a worker remembers, the longest of them, and transitions it keeps: about 150 MB at most, whatever the texts.
REMEMBERED, LONGEST, STEPS = 250_000, 64, 1_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_pieces(path: str) -> list[bytes]:
    """The pieces of a vocabulary file with a base64 piece and a number on each line."""
    import base64

    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """States are numbers; state 0 starts a word, state 1 what follows a piece."""

    def __init__(self, pieces: list[bytes], mark: bytes = b" ") -> None:
        self.mark = mark
        first = [p for p in pieces if p.startswith(mark)]
        later = [p for p in pieces if not p.startswith(mark)]
        self.children: list[dict[int, int]] = [{}, {}]
        self.fail, self.pops, final = [-1, -1], [0, 0], {}
        for root, group in ((0, first), (1, later)):
            for piece in group:
                state = root
                for byte in piece:
                    following = self.children[state].get(byte)
                    if following is None:
                        following = self.children[state][byte] = len(self.children)
                        self.children.append({})
                        self.fail.append(-1)
                        self.pops.append(0)
                    state = following
                final[state] = True
        # level by level, so that what a failure link leads to is settled before it is used
        level = [0, 1]
        while level:
            below = []
            for state in level:
                for byte, child in self.children[state].items():
                    if child in final:
                        self.fail[child], self.pops[child] = 1, 1
                    else:
                        at, popped = self.fail[state], self.pops[state]
                        while at >= 0 and byte not in self.children[at]:
                            popped += self.pops[at]
                            at = self.fail[at]
                        if at >= 0:
                            self.fail[child], self.pops[child] = self.children[at][byte], popped
                    below.append(child)
            level = below
        self.steps: dict[int, tuple[int, int]] = {}
        self.counts: dict[bytes, int] = {}

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """(state, pieces popped) after a byte, over as many failure links as it takes."""
        popped = 0
        while byte not in self.children[state]:
            popped += self.pops[state]
            state = self.fail[state]
            if state < 0:
                raise ValueError(f"byte {byte} is no piece of the vocabulary")
        return self.children[state][byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of one word, mark excluded."""
        state, total, steps = 0, 0, self.steps
        for byte in self.mark + word:
            key = state << 8 | byte
            if (known := steps.get(key)) is None:
                if len(steps) >= STEPS:
                    steps.clear()
                known = steps[key] = self._step(state, byte)
            state, popped = known
            total += popped
        while state > 1:  # the end of the word fits nowhere: pop what is left
            total += self.pops[state]
            state = self.fail[state]
        return total

    def known(self, word: bytes) -> int:
        """The count of a word, from memory where it is short and was seen."""
        if (n := self.counts.get(word)) is None:
            n = self.count(word)
            if len(word) <= LONGEST:
                if len(self.counts) >= REMEMBERED:
                    self.counts.clear()
                self.counts[word] = n
        return n

    def text(self, text: bytes | None) -> tuple[int, int, int]:
        """(words, tokens, most tokens of a word) of a text."""
        words = (text or b"").split()
        if not words:
            return 0, 0, 0
        counts = list(map(self.known, words))
        return len(words), sum(counts), max(counts)


@lru_cache(maxsize=1)
def automaton(path: str) -> Automaton:
    return Automaton(load_pieces(path))


common.held("wordpiece", automaton.cache_clear)


@common.shielded
def with_counts(documents: DataFrame, *, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Documents with n_words, n_tokens and max_word_tokens."""
    path = vocabulary or vocabulary_path()

    def run(texts: pa.Array) -> pa.Array:
        a = automaton(path)
        return pa.array([a.text(t) for t in common.utf8(texts)], pa.struct([("n_words", pa.int64()), ("n_tokens", pa.int64()), ("max_word_tokens", pa.int64())]))

    counted = documents.withColumn("__c", common.arrow_udf("wordpiece", run, "n_words long, n_tokens long, max_word_tokens long")(F.col(f"`{text}`")))
    return counted.withColumns({k: F.col(f"__c.{k}") for k in ("n_words", "n_tokens", "max_word_tokens")}).drop("__c")


def op9_token_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_tokens, max_word_tokens) of each document."""
    return with_counts(documents.select("doc_id", "text")).select("doc_id", "n_words", "n_tokens", "max_word_tokens")


def brute_force(text: str | None, pieces: set[bytes], mark: bytes = b" ") -> tuple[int, int, int]:
    """Longest piece first, for tests."""
    counts, longest = [], max(map(len, pieces))
    for word in (text or "").encode().split():
        left, n = mark + word, 0
        while left:
            k = next(k for k in range(min(longest, len(left)), 0, -1) if left[:k] in pieces and (n == 0) == left[:k].startswith(mark))
            left, n = left[k:], n + 1
        counts.append(n)
    return len(counts), sum(counts), max(counts, default=0)
