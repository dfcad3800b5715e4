"""Token counts by greedy longest match, one pass over each word and no pieces built.

Vocabulary: a file of byte pieces (base64 and rank a line). A word is a run of bytes other than ASCII white space; it is
read as one space and its bytes, and cut greedily into the longest pieces of the vocabulary. Every byte is a piece, so
every word has a cut.

The automaton is a trie whose nodes have failure links. When no child matches the next byte, node v stands for a text
whose greedy cut has begun: popped[v] pieces leave at once, and the match goes on at link[v], which stands for what is
left. Both are computed once per vocabulary, so each byte costs a bounded number of steps and only counts are added.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

NONE = -1


class Automaton:
    """count(word) is the number of pieces in the greedy longest-match cut of the bytes in word."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        text: list[bytes] = [b""]
        ends: list[bool] = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    text.append(text[node] + bytes([byte]))
                    ends.append(False)
                node = children[node][byte]
            ends[node] = bool(piece)
        if any(b not in children[0] or not ends[children[0][b]] for b in range(256)):
            raise ValueError("every byte must be a piece")
        size = len(children)
        link, popped = [NONE] * size, [0] * size
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in children[node].items():
                    below.append(child)
                    if ends[child]:
                        link[child], popped[child] = 0, 1
                        continue
                    at, count = link[node], popped[node]
                    while at != NONE and byte not in children[at]:
                        count, at = count + popped[at], link[at]
                    if at != NONE:
                        link[child], popped[child] = children[at][byte], count
            level = below
        self.children, self.link, self.popped = children, link, popped

    def count(self, word: bytes) -> int:
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for byte in word:
            while byte not in children[node]:
                total += popped[node]
                node = link[node]
            node = children[node][byte]
        while node:
            total += popped[node]
            node = link[node]
        return total


class Counts(dict):
    """Counts of words met lately; a word that is missing goes through the automaton."""

    MOST = 400_000

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= 64:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = n
        return n


def read_pieces(path: str) -> list[bytes]:
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


@lru_cache(2)
def counts(path: str) -> Counts:
    return Counts(Automaton(read_pieces(path)))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of every document's whole text.

    vocabulary: path of the file of pieces, present on every machine. Null and empty texts have 0 words and 0 tokens;
    repeated rows stay; a null doc_id stays null; other columns are ignored. No shuffle: one narrow pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts(vocabulary)
        for batch in batches:
            bodies = batch.column("text").to_pylist()
            words = [x.split() for x in bodies]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in bodies], pa.int64()),
                    pa.array([len(x) for x in words], pa.int64()),
                    pa.array([sum(map(known.__getitem__, x)) for x in words], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_words", "n_tokens"],
            )

    return texts(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as binary) text").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_words bigint, n_tokens bigint"
    )
