"""Byte-level BPE encoding and decoding with overlapping chunks.

A long text is cut into chunks of `chunk` characters. The words (pre-tokens) around each cut are found twice, from
`overlap` characters before the cut and from the cut itself: the first place at or behind the cut where both have a
boundary is where the two resynchronise, and there the text is really cut. Both sides of a cut compute the same place
from the same characters, so that chunks are encoded apart and nothing is sent between them. Each chunk then checks that
its own words, counted from its true start, have a boundary at its end. By induction from the first chunk every cut is
then a boundary of the whole text. A text of which a chunk fails the check is encoded in one go.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

CHUNK, OVERLAP = 50_000, 500


class Codec:
    """Encoder and decoder for a file of ranks (base64 and rank a line) and a pattern that finds words."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.words = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.digits = [str(i) for i in range(size)]
        self.bytes = [b""] * size
        for piece, rank in ranks.items():
            self.bytes[rank] = piece

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Starts of words in text[start:end] as counted from start, without those that the end may have changed."""
        found = [m.start() for m in self.words.finditer(text, start, end)]
        return found if end == len(text) else found[:-2]

    def cut(self, text: str, at: int, overlap: int) -> int | None:
        """The place at or behind `at` where words counted from `at` and from `overlap` before it resynchronise."""
        end = min(len(text), at + overlap)
        before = set(self.boundaries(text, max(0, at - overlap), end))
        return next((b for b in self.boundaries(text, at, end) if b in before), None)

    def chunk_ids(self, around: str, begin: int, end: int, first: bool, last: bool, overlap: int) -> list[int] | None:
        """Ids of the chunk that lies at begin to end in around, a stretch with 2 * overlap characters more on each side."""
        start = 0 if first else self.cut(around, begin, overlap)
        stop = len(around) if last else self.cut(around, end, overlap)
        if start is None or stop is None or stop < start:
            return None
        if not last:  # the words as counted from the true start must have a boundary at the cut
            tail = max(start, stop - 4 * overlap)
            seen = self.boundaries(around, start, len(around)) if tail == start else self.resumed(around, start, stop)
            if stop not in seen and stop != start:
                return None
        return self.encode(around[start:stop])

    def resumed(self, text: str, start: int, stop: int) -> set[int]:
        out, last = set(), start
        for m in self.words.finditer(text, start):
            if m.start() >= stop:
                out.add(m.start())
                break
            last = m.end()
        return out | {last}


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row, doc_id, part, ids (array<int>; null where the cut failed), body: the ids of every chunk of every document.

    row tells repeated rows and null doc_ids apart. Null and empty texts give one part without ids. body is set only for
    texts of more than one chunk, so that such a text can be encoded in one go where a cut fails.
    """
    rows = texts(docs).select(F.expr("uuid()").alias("row"), F.col("doc_id").cast("bigint"), "text")
    parts = rows.select(
        "row", "doc_id", F.length("text").alias("size"), "text",
        F.explode(F.expr(f"sequence(0, cast(greatest(0, (length(text) - 1) div {chunk}) as int))")).alias("part"),
    )
    wide = 2 * overlap
    begin = F.col("part") * chunk
    low = F.greatest(F.lit(0), begin - wide)
    parts = parts.select(
        "row", "doc_id", "part", "size",
        F.when(F.col("size") <= chunk, F.col("text")).otherwise(F.expr(f"substring(text, cast(greatest(0, part * {chunk} - {wide}) + 1 as int), {chunk + 2 * wide})")).alias("around"),
        (begin - low).cast("int").alias("begin"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            ids, bodies = [], []
            for part, size, around, begin in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "around", "begin")), strict=True):
                if size <= chunk:
                    ids.append(tool.encode(around))
                    bodies.append(None)
                    continue
                last = (part + 1) * chunk >= size
                end = len(around) if last else begin + chunk
                stretch = around if last else around[: begin + chunk + wide]
                ids.append(tool.chunk_ids(stretch, begin, end, part == 0, last, overlap))
                bodies.append(around[begin:end])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("part"), pa.array(ids, pa.list_(pa.int32())), pa.array(bodies, pa.string())],
                ["row", "doc_id", "part", "ids", "body"],
            )

    return parts.mapInArrow(run, "row string, doc_id bigint, part int, ids array<int>, body string")


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chunks of every document: encoded, then decoded from the ids.

    Short texts never leave their task. Chunks of longer texts are encoded apart and meet by document for the digests.
    A null or empty text has no ids and the digests of nothing; repeated rows give repeated rows.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_chunks int"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks"]

    def digests(doc_ids, many: list[list[int]], chunks: list[int]) -> pa.RecordBatch:
        tool = codec(path, pattern)
        said = [hashlib.sha256(",".join(map(tool.digits.__getitem__, x)).encode()).hexdigest() for x in many]
        back = [hashlib.sha256(tool.decode(x)).hexdigest() for x in many]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(list(map(len, many)), pa.int64()), pa.array(said), pa.array(back), pa.array(chunks, pa.int32())], names
        )

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                many = [tool.encode(x) for x in piece.column("text").to_pylist()]
                yield digests(piece.column("doc_id"), many, [1] * len(many))

    def stitched(table: pa.Table) -> pa.Table:
        tool = codec(path, pattern)
        table = table.sort_by("part")
        ids = table.column("ids").to_pylist()
        if any(x is None for x in ids):
            whole = tool.encode("".join(table.column("body").to_pylist()))
        else:
            whole = [i for x in ids for i in x]
        return pa.Table.from_batches([digests(table.column("doc_id").to_pylist()[:1], [whole], [len(ids)])])

    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    low = rows.where(F.length("text") <= chunk).mapInArrow(short, schema)
    high = encode(rows.where(F.length("text") > chunk), path, pattern, chunk, overlap).groupBy("row").applyInArrow(stitched, schema)
    return low.union(high)
