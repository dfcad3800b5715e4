"""Packing into windows by deficit round-robin over source queues.

Each source is a queue of its documents' tokens, with a weight: its target share of every window. In every round of the
round-robin each queue earns its share of the window as credit and sends whole tokens for it; what it could not send, its
deficit, is carried to the next window, and so on over all partitions. A queue that has run dry earns no more, and the
others share what it would have had by their weights. By default a weight is the queue's length, so that all run dry
together. No window but the last has padding either way. Whose turn is next is decided by deficit: of a queue of weight w,
token x is due at time (2x + 1) / 2w, ties by the order of the queues. So the tokens sent by the end of a window follow from
the queues' lengths and weights alone, in exact integers: Schedule finds them without playing earlier windows, and windows
are filled in parallel with no state passed on from task to task. No queue is ever behind or ahead of its share by more
than about half a token for each queue.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts

WINDOW = 4096
#: Sources with a queue of their own at most: their lengths are collected, and a window's schedule looks at each.
QUEUES = 1024
#: Text on which lower case, NFC and the word pattern are the same by any library: printable ASCII and Latin-1 letters.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own pattern on such text.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The bytes, in Latin-1, of texts all of whose words are plain, and of the white space between them.
PLAIN_BYTES = bytes([*range(9, 14), *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Kept(dict):
    """What was made of keys. When there are MOST of them they become the older ones, and those before are forgotten: frequent keys stay."""

    MOST = 400_000

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.made(key)
        if len(key) <= 64:
            if len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


class Pieces(Kept):
    """Ids, as 16-bit little-endian bytes, of the pattern's matches in plain text."""

    MOST = 300_000

    def __init__(self, model):
        super().__init__()
        self.model = model
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(kept))}

    def made(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)  # ASCII pieces show as they are
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}H", *ids)


class Lowered(Kept):
    """Ids of stretches without white space of plain text in lower case, in Latin-1 bytes."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def made(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters, and a mark after them: what most text consists of
            return self.pieces[chunk.decode()]
        if chunk[-1:] in Chunks.MARKS and chunk[:-1].isalpha():
            return self.pieces[chunk[:-1].decode()] + self.pieces[chunk[-1:].decode()]
        return b"".join(map(self.pieces.__getitem__, WORDS.findall(chunk.decode("latin-1"))))


class Chunks(Kept):
    """Ids, as 16-bit little-endian bytes, of stretches without ASCII white space; a missing one is encoded.

    The tokenizer drops white space and neither joins nor changes anything across it, so that a text's ids are those of
    its stretches in a row.
    """

    MARKS = frozenset(bytes([b]) for b in b".,;:!?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        usual = PATTERN in json.dumps(said["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") and len(said["model"]["vocab"]) <= 65536
        if len(said["model"]["vocab"]) > 65536:
            raise ValueError("ids are kept in 16 bits")
        self.usual, self.plain = usual, PLAIN if usual else re.compile(r"(?!)")
        self.pieces = Pieces(self.tokenizer.model)
        self.lowered = Lowered(self.pieces)

    def of(self, text: bytes) -> bytes:
        """The ids of a text. One of plain words and white space alone is put in lower case as a whole, so that fewer different words are met."""
        plain = text if text.isascii() else latin(text)
        if not self.usual or plain is None or plain.translate(None, PLAIN_BYTES) or b"<|" in plain:
            return b"".join(map(self.__getitem__, text.split()))
        low = plain.lower() if plain is text else plain.decode("latin-1").lower().encode("latin-1")
        return b"".join(map(self.lowered.__getitem__, low.split()))

    def made(self, chunk: bytes) -> bytes:
        word, mark = (chunk[:-1], chunk[-1:]) if chunk[-1:] in self.MARKS else (chunk, b"")
        text = chunk.decode()
        if self.usual and word.isalpha():
            return self.pieces[word.lower().decode()] + (self.pieces[mark.decode()] if mark else b"")
        if self.plain.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, WORDS.findall(text.lower())))
        return b"".join(i.to_bytes(2, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)


def latin(text: bytes) -> bytes | None:
    """A text in Latin-1, if it has no other characters."""
    try:
        return text.decode().encode("latin-1")
    except UnicodeEncodeError:
        return None


@lru_cache(2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """task, queue, source, doc_id, start, n, ids: every document's ids, and its place among the task's tokens of its queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent, end = chunks(path), {}, end_id.to_bytes(2, "little")
        for batch in batches:
            ids = [known.of(x) + end for x in batch.column("text").to_pylist()]
            starts = []
            for queue, x in zip(batch.column("queue").to_pylist(), ids, strict=True):
                starts.append(sent.get(queue, 0))
                sent[queue] = starts[-1] + len(x) // 2
            kept = [batch.column(c) for c in ("task", "queue", "source", "doc_id")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(starts, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["task", "queue", "source", "doc_id", "start", "n", "ids"],
            )

    rows = texts(docs, "queue", "source").select(F.spark_partition_id().alias("task"), "queue", "source", F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "task int, queue string, source string, doc_id bigint, start bigint, n bigint, ids binary")


class Schedule:
    """sent(w): how many tokens of each queue lie in the first w windows. weights: whole numbers above 0; default: sizes."""

    def __init__(self, sizes: list[int], window: int, weights: list[int] | None = None):
        self.sizes, self.window, self.total, self.weights = sizes, window, sum(sizes), weights or sizes
        self.known: dict[int, list[int]] = {}
        #: Queues in the order in which they run dry, and for each number of dry ones their tokens and the others' weight.
        self.dry = sorted(range(len(sizes)), key=lambda s: Fraction(sizes[s], self.weights[s]))
        self.times = [sizes[s] / self.weights[s] for s in self.dry]
        self.gone = [0, *accumulate(sizes[s] for s in self.dry)]
        self.left = [sum(self.weights), *(sum(self.weights) - x for x in accumulate(self.weights[s] for s in self.dry))]
        #: Tokens sent by the time at which each runs dry.
        self.when = [self.gone[i] + Fraction(self.left[i] * sizes[s], self.weights[s]) for i, s in enumerate(self.dry)]

    def sent(self, w: int) -> list[int]:
        if w not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[w] = self._sent(min(self.total, w * self.window))
        return self.known[w]

    def _sent(self, m: int) -> list[int]:
        sizes, weights = self.sizes, self.weights
        n = bisect_right(self.when, m)
        if n == len(sizes):
            return list(sizes)
        up, down = m - self.gone[n], self.left[n]  # m tokens are sent at the time up / down
        out = [min(t, (2 * w * up + down) // (2 * down)) for t, w in zip(sizes, weights, strict=True)]
        for s in self.dry[:n]:
            out[s] = sizes[s]
        short = m - sum(out)
        if short > 0:
            turns = [(Fraction(2 * c + 1, 2 * w), s) for s, (c, t, w) in enumerate(zip(out, sizes, weights, strict=True)) if c < t]
            heapq.heapify(turns)
            for _ in range(short):
                _, s = turns[0]
                out[s] += 1
                heapq.heapreplace(turns, (Fraction(2 * out[s] + 1, 2 * weights[s]), s)) if out[s] < sizes[s] else heapq.heappop(turns)
        elif short < 0:
            turns = [(-Fraction(2 * c - 1, 2 * w), -s) for s, (c, w) in enumerate(zip(out, weights, strict=True)) if c]
            heapq.heapify(turns)
            for _ in range(-short):
                s = -turns[0][1]
                out[s] -= 1
                heapq.heapreplace(turns, (-Fraction(2 * out[s] - 1, 2 * weights[s]), -s)) if out[s] else heapq.heappop(turns)
        return out

    def first(self, s: int, x: int) -> int:
        """The window that holds token x of queue s: it is looked for around the window that is open when the token is due."""
        time = (2 * x + 1) / (2 * self.weights[s])
        n = bisect_right(self.times, time)
        due = self.gone[n] + int(self.left[n] * time)
        low = high = max(0, min(due // self.window, (self.total - 1) // self.window))
        step = 1
        while low > 0 and self.sent(low)[s] > x:
            low, high, step = max(0, low - step), low, 2 * step
        while self.sent(high + 1)[s] <= x:
            low, high, step = high + 1, high + step, 2 * step
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.sent(mid + 1)[s] > x else (mid + 1, high)
        return low

    def pieces(self, s: int, x: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of n tokens that begin at place x of queue s."""
        done, w = 0, self.first(s, x)
        while done < n:
            low, high = self.sent(w), self.sent(w + 1)
            if high[s] > x + done:
                length = min(high[s] - x, n) - done
                yield done, length, w, sum(high[:s]) - sum(low[:s]) + x + done - low[s]
                done += length
                w += 1
            else:
                w = self.first(s, x + done)


def weights_of(queues: list[tuple[str, int]], shares: dict[str, float] | None) -> list[int]:
    """Whole weights in the proportion of the shares; queues without one have the share that they have of all tokens."""
    if shares and min(shares.values()) <= 0:
        raise ValueError("shares must be above 0")
    total = sum(size for _, size in queues)
    parts = [Fraction(shares[name]).limit_denominator(10**9) if shares and name in shares else Fraction(size, total) for name, size in queues]
    scale = math.lcm(*(p.denominator for p in parts))
    return [int(p * scale) for p in parts]


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, shares: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    path: the tokenizer's file, present on every machine. shares: target proportions of tokens by source, in every window
    until a source has run dry; a source that is not named has its own share of all tokens. Null and empty texts consist of
    the end id alone; a null source is the source ''; repeated rows are packed each; an empty table gives no piece. Only the
    last sequence has padding. Sources in shares have a queue each, and so have others, if they are no more than QUEUES in
    all; else the others are dealt to that many queues by hash. Token ids are kept once, in 16 bits, in the shared folder;
    queues' lengths are summed per task, and the places of the tasks in a queue are running sums over tasks, partitioned by
    queue.
    """
    source = F.coalesce(docs["source"], F.lit(""))
    queue, named = source, list(shares or ())
    if docs.select(source.alias("source")).where(~F.col("source").isin(named)).distinct().limit(QUEUES + 1).count() > QUEUES:
        dealt = F.concat(F.lit("\0"), F.pmod(F.xxhash64(source), F.lit(QUEUES)).cast("string"))
        queue = F.when(source.isin(named), source).otherwise(dealt)
    ids = stored(tokenized(docs.select("doc_id", "text", source.alias("source"), queue.alias("queue")), path, end_id), "ids")
    per_task = ids.groupBy("queue", "task").agg(F.sum("n").alias("size"))
    in_order = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    places = stored(per_task.withColumn("base", F.coalesce(F.sum("size").over(in_order), F.lit(0))), "places")
    queues = sorted((r["queue"], r["size"]) for r in places.groupBy("queue").agg(F.sum("size").alias("size")).collect())
    names, sizes, weights = {name: i for i, (name, _) in enumerate(queues)}, [size for _, size in queues], weights_of(queues, shares) if queues else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(sizes, window, weights)
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "queue", "source", "x", "n", "ids"))
            for doc_id, name, own, x, n, ids in zip(*columns, strict=True):
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                for start, length, sequence, offset in schedule.pieces(names[name], x, n):
                    out.append((doc_id, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, sequence, offset, own))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(columns)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    rows = ids.join(places, ["queue", "task"]).select("doc_id", "queue", "source", (F.col("base") + F.col("start")).alias("x"), "n", "ids")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string")
