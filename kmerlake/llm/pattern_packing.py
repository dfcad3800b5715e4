"""Best-fit packing by patterns: few-document patterns of lengths, repeated as non-negative least squares say.

1. Every document's ids are found once, in the tasks that read the texts; pieces follow from the document alone. A task
   numbers its pieces of each length, and running sums over tasks make that the piece's rank among all pieces of its length.
2. The histogram of lengths, at most `window` numbers, is all that the driver sees. Patterns of up to three lengths that
   fill a window exactly are enumerated; how often to repeat each is fitted to the histogram by non-negative least squares
   (multiplicative updates, weighted by length) and rounded, never to more pieces than there are. A share of each length is
   kept from the fit.
3. That share and what the rounded patterns leave, the residuals, are packed best fit, longest first, as counts: one step places all
   pieces of a length that go into sequences with the same room.
4. Each pattern takes a range of ranks of each of its lengths, so that a piece finds its sequence and offset in that small
   table, whose size is bounded by the window, by its length and rank alone.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts

WINDOW = 2048
#: Rounds of the fit.
ROUNDS = 200
#: Share of the pieces of each length that no pattern takes, so that the residuals have all lengths to fill gaps with.
KEPT = 0.2
PIECE = "task int, rank bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, as 32-bit little-endian bytes, its special tokens included.

    Texts are split at special tokens, then by the pattern of words that byte-level files of this kind share; files with
    another set-up are refused. Merges in the order of their ranks are what the file's merges say.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if said["model"]["type"] != "BPE" or said["normalizer"] or not usual.items() <= (said["pre_tokenizer"] or {}).items():
            raise ValueError("a byte-level BPE file is needed")
        special = {x["content"]: x["id"] for x in said["added_tokens"]}
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(kept)]
        byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in said["model"]["vocab"].items() if piece not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    """task, rank (from 0, among the task's pieces of that length) and the pieces of every document; ids are null unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, end = encoder(path), [0] * (window + 1), struct.pack("<I", end_id)
        for batch in batches:
            out: list[tuple] = []
            for task, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("task", "doc_id", "text")), strict=True):
                data = memoryview(encode(text) + end)
                total = len(data) // 4
                at, size, piece = 0, total % window or window, 0
                while at < total:
                    body = data[4 * at : 4 * (at + size)]
                    out.append((task, seen[size], doc_id, piece, at, size, zlib.crc32(body), total, bytes(body) if with_ids else None))
                    seen[size] += 1
                    at, size, piece = at + size, window, piece + 1
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECE.split(", ")])

    rows = texts(docs).select(F.spark_partition_id().alias("task"), F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, PIECE)


def patterns(counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, descending, 0 for none, that fill the window: those of two or three lengths that occur."""
    there = counts > 0
    own = np.flatnonzero(there[: window]).astype(np.int64)
    out = [np.stack([window - b, b, np.zeros_like(b)], 1) for b in [own[(own > 0) & (2 * own <= window)]]]
    for c in own[(own > 0) & (3 * own <= window)]:
        b = own[(own >= c) & (2 * own <= window - c)]
        out.append(np.stack([window - c - b, b, np.full_like(b, c)], 1))
    rows = np.concatenate(out)
    return rows[there[rows[:, 0]]]


def fitted(rows: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that comes near the least length-weighted squares of (lengths used by x - counts), by multiplicative updates."""
    if not len(rows):
        return np.zeros(0)
    size = len(counts)
    weight = np.arange(size, dtype=float)  # 0 for no length
    wanted = (weight * counts)[rows].sum(1)
    x = np.full(len(rows), counts[1:].sum() / (3 * len(rows)))
    for _ in range(rounds):
        used = np.bincount(rows.ravel(), np.repeat(x, 3), size)
        x *= wanted / np.maximum((weight * used)[rows].sum(1), 1e-300)
    return x


def rounded(rows: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(pattern, repeats) in whole numbers that follow x's running sum, longest first, and the counts that are left."""
    left = counts.tolist()
    order = np.lexsort((rows[:, 1], -rows[:, 0])) if len(rows) else np.zeros(0, np.int64)
    sums = np.floor(np.cumsum(x[order]) + 0.5).astype(np.int64)
    repeats = np.diff(np.r_[0, sums])
    out = []
    for row, n in zip(rows[order][repeats > 0].tolist(), repeats[repeats > 0].tolist(), strict=True):
        own = [v for v in row if v]
        n = min(n, *(left[v] // own.count(v) for v in own))
        if n > 0:
            for v in own:
                left[v] -= n
            out.append((tuple(own), n))
    return out, np.array(left, np.int64)


def best_fit(counts: np.ndarray, window: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(contents as (length, copies), sequences) of pieces packed best fit, longest first, all sequences with like contents at once."""
    room: list[list] = [[] for _ in range(window + 1)]
    some = np.zeros(window + 1, bool)

    def put(space: int, inside: tuple, n: int) -> None:
        room[space].append((inside, n))
        some[space] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            at = int(np.argmax(some[length:])) + length
            if not some[at]:
                each = min(window // length, n)
                put(window - each * length, ((length, each),), n // each)
                n %= each
                continue
            inside, bins = room[at].pop()
            some[at] = bool(room[at])
            each = min(at // length, -(-n // bins))  # copies that go into each
            full = n // each if each * bins > n else bins
            put(at - each * length, (*inside, (length, each)), full)
            if bins > full:
                put(at, inside, bins - full)
            n -= each * full
    return [x for space in room for x in space]


def slots(counts: np.ndarray, window: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset), by length and rank: where the pieces of each length go."""
    given = np.ceil(counts * (1 - KEPT)).astype(np.int64)
    rows = patterns(given, window)
    few, left = rounded(rows, fitted(rows, given), given)
    contents = [(tuple((v, p.count(v)) for v in dict.fromkeys(p)), n) for p, n in few]
    used, sequence, out = [0] * (window + 1), 0, []
    for inside, n in contents + best_fit(left + counts - given, window):
        offset = 0
        for length, copies in inside:
            out.append((length, used[length], sequence, copies, offset))
            used[length] += n * copies
            offset += length * copies
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, 32 bits each; null unless asked for).

    path: the tokenizer's file, present on every machine. A null or empty text is the end id alone. A document of over
    `window` ids is cut into pieces of `window`, of which the first may be shorter. Repeated rows are packed each; null
    doc_ids stay null; an empty table gives no piece. Other columns of docs are not read.
    """
    found = stored(pieces(docs, path, end_id, window, with_ids), "pieces")
    per_task = stored(found.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(window + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        counts[r["length"]] = r["n"]
    table = docs.sparkSession.sparkContext.broadcast(slots(counts, window))
    in_order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, copies, offset = table.value.T
        keys = length << 48 | first
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            at = np.searchsorted(keys, own << 48 | rank, "right") - 1
            inside = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence[at] + inside // copies[at]), pa.array(offset[at] + inside % copies[at] * own), batch.column("ids")],
                [*names, "sequence_id", "offset", "ids"],
            )

    placed = found.join(bases, ["length", "task"]).select(*names, (F.col("base") + F.col("rank")).alias("place"), "ids")
    return placed.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
