"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry at each place of a word. A
trie of the vocabulary with failure links finds how many pieces that gives in
one pass over the letters: each node knows to which node to fall back when no
longer entry fits, and how many pieces are done (*popped*) on the way, so no
piece is ever built and no letter is read twice.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import text_bytes, text_of
from landloom.llm.pieces import byte_letters

VOCABULARY = "byte_bpe_50k.json"
START = b" "
MOST = 300_000


class LongestMatch:
    """Counts of greedy longest-match pieces over a vocabulary of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]):
        # goto[node << 8 | byte]; node 0 is the root.
        self.goto: dict[int, int] = {}
        parent, letter, whole = [0], [0], [False]
        for entry in vocabulary:
            if not entry:
                continue
            node = 0
            for byte in entry:
                key = node << 8 | byte
                if key not in self.goto:
                    self.goto[key] = len(parent)
                    parent.append(node)
                    letter.append(byte)
                    whole.append(False)
                node = self.goto[key]
            whole[node] = True
        self.fail, self.popped = [-1] * len(parent), [0] * len(parent)
        depth = [0] * len(parent)
        for node in range(1, len(parent)):  # a parent's number is below its child's
            depth[node] = depth[parent[node]] + 1
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            if whole[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            back, count = self.fail[parent[node]], self.popped[parent[node]]
            while back >= 0 and back << 8 | letter[node] not in self.goto:
                count += self.popped[back]
                back = self.fail[back]
            if back >= 0:
                self.fail[node], self.popped[node] = self.goto[back << 8 | letter[node]], count

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1 (the unknown piece) if it cannot be cut up; 0 if empty."""
        goto, fail, popped = self.goto, self.fail, self.popped
        node = total = 0
        for byte in word:
            while (to := goto.get(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return 1
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return 1
            total += popped[node]
            node = fail[node]
        return total


def byte_level_vocabulary(path: str) -> list[bytes]:
    """Entries of a byte-level vocabulary file as bytes (added tokens left out)."""
    back = {c: b for b, c in byte_letters().items()}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    added = {t["content"] for t in data.get("added_tokens", ())}
    return [bytes(back[c] for c in token) for token in data["model"]["vocab"] if token not in added]


@functools.cache
def automaton(path: str) -> LongestMatch:
    """One automaton per worker process and vocabulary file."""
    return LongestMatch(byte_level_vocabulary(path))


class Counts(dict):
    """Word to its count; natural text repeats its words. Emptied when large."""

    def __init__(self, matcher: LongestMatch, start: bytes):
        super().__init__()
        self.matcher, self.start = matcher, start

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.matcher.count(self.start + word)
        return n


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", start: bytes = START) -> DataFrame:
    """``doc_id, n_words, n_tokens`` per input row.

    Words are runs of non-white characters; every word is counted with
    ``start`` before it (the vocabulary's mark of a word's beginning). Null and
    empty texts have none; repeated rows stay; other columns are ignored.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Counts(automaton(path), start)
        for batch in batches:
            words, tokens = [], []
            for t in text_bytes(batch.column("t")):
                if len(table) > MOST:
                    table.clear()
                own = t.split()
                words.append(len(own))
                tokens.append(sum(map(table.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
