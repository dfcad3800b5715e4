"""The plain-matrix index file, little-endian, as a data source that is read and written in parallel.

In order: a length-prefixed version ("v0.1", or "plain-matrix" and then "v0.1"); the bit vectors of A, C, G and T, each its
number of bits and 64-bit words; four rank supports and one suffix-group vector, each its number of bits and words; the
offset map and the prefix table, each its number of bytes and bytes; and the prefix length, the numbers of nodes and of
k-mers, and k. Readers use the four vectors and k, and skip the rest.

    spark.read.format("kmer_index").load(path)                                   pos, a, c, g, t
    words.write.format("kmer_index").option("k", 31).mode("overwrite").save(path)  word, n, a, c, g, t

A reading task has a range of words, which it reads from all four vectors; conditions on pos narrow the ranges before any
task begins. A writing task writes the words of a range to files of its own, and the commit puts these behind one another.
Files lie in any store that pyarrow opens by its address: local or mounted folders, HDFS, S3, GCS.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from kmerlake.operators import index as X
from kmerlake.operators.lineage import checkpointed

from .files import Parts, created, opened

#: Words of each vector that one task reads, and that it turns to rows at a time.
SPLIT, STEP = 1 << 18, 1 << 11
VERSIONS = ("plain-matrix", "v0.1")


def layout(path: str) -> dict:
    """k, rows, and where each letter's words begin, without reading the vectors."""
    system, inside = opened(path)
    with system.open_input_file(inside) as file:

        def number() -> int:
            data = file.read(8)
            if len(data) < 8:
                raise ValueError("not an index file: it ends early")
            return int.from_bytes(data, "little")

        def word() -> str:
            n = number()
            if not 0 < n <= 64:
                raise ValueError("not an index file")
            return file.read(n).decode(errors="replace")

        def skipped() -> tuple[int, int]:
            bits, at = number(), file.tell()
            file.seek(at + -(-bits // 64) * 8)
            return bits, at

        version = word()
        if version == VERSIONS[0]:
            version = word()
        if version != VERSIONS[1]:
            raise ValueError(f"unknown index version {version!r}")
        vectors = [skipped() for _ in range(4)]
        for _ in range(5):
            skipped()
        for _ in range(2):
            n = number()
            file.seek(file.tell() + n)
        prefix, nodes, kmers, k = (number() for _ in range(4))
    return {"k": k, "rows": vectors[0][0], "n_nodes": nodes, "n_kmers": kmers, "prefix": prefix, "at": [v[1] for v in vectors]}


@dataclass
class Words(InputPartition):
    """Words begin to end - 1 of each vector."""

    begin: int
    end: int


class IndexSource(DataSource):
    """Option split: words of a reading task. Option k, needed for writing: the length of k-mers."""

    @classmethod
    def name(cls) -> str:
        return "kmer_index"

    def schema(self) -> str:
        return "pos bigint, a boolean, c boolean, g boolean, t boolean"

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return IndexWriter(self.options["path"], int(self.options["k"]), overwrite)


class IndexReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.about = path, split, layout(path)
        self.low, self.high = 0, self.about["rows"]  # rows that conditions leave

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("pos",) or not self.narrowed(f):
                yield f

    def narrowed(self, f: Filter) -> bool:
        """Whether a condition on pos is fully met by the rows that are left."""
        low, high, whole = self.low, self.high, True
        if isinstance(f, EqualTo):
            low, high = f.value, f.value + 1
        elif isinstance(f, GreaterThan):
            low = f.value + 1
        elif isinstance(f, GreaterThanOrEqual):
            low = f.value
        elif isinstance(f, LessThan):
            high = f.value
        elif isinstance(f, LessThanOrEqual):
            high = f.value + 1
        elif isinstance(f, In) and f.value:
            low, high, whole = min(f.value), max(f.value) + 1, False
        elif not isinstance(f, IsNotNull):
            whole = False
        self.low, self.high = max(self.low, low), min(self.high, high)
        return whole

    def partitions(self) -> list[InputPartition]:
        first, last = self.low // 64, -(-max(self.low, self.high) // 64)
        return [Words(w, min(last, w + self.split)) for w in range(first, last, self.split)] or [Words(0, 0)]

    def read(self, partition: Words) -> Iterator[pa.RecordBatch]:
        system, inside = opened(self.path)
        with system.open_input_file(inside) as file:
            for begin in range(partition.begin, partition.end, STEP):
                size = min(STEP, partition.end - begin)
                low, high = max(self.low, 64 * begin), min(self.high, 64 * (begin + size))
                bits = []
                for at in self.about["at"]:
                    data = np.frombuffer(file.read_at(8 * size, at + 8 * begin), np.uint8)
                    bits.append(np.unpackbits(data, bitorder="little")[low - 64 * begin : high - 64 * begin])
                if high > low:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), *(pa.array(x.astype(bool)) for x in bits)], ["pos", *X.LETTERS])


@dataclass
class Written(WriterCommitMessage):
    """Words of a task: the first, how many, the rows that they stand for, and its files' name."""

    first: int
    words: int
    rows: int
    name: str


class IndexWriter(DataSourceArrowWriter):
    """Takes rows (word, n, a, c, g, t) that are in order inside tasks, which hold ranges of words."""

    def __init__(self, path: str, k: int, overwrite: bool):
        self.path, self.k, self.parts = path, k, Parts(path)
        system, inside = opened(path)
        if not overwrite and system.get_file_info(inside).type != fs.FileType.NotFound:
            raise FileExistsError(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, first, words, rows, files = uuid.uuid4().hex, -1, 0, 0, []
        try:
            for batch in iterator:
                if not len(batch):
                    continue
                if not files:
                    files = [self.parts.create(f"{name}-{x}") for x in X.LETTERS]
                    first = batch.column("word")[0].as_py()
                at = batch.column("word").to_numpy()
                if not (at == np.arange(first + words, first + words + len(at))).all():
                    raise ValueError("words are missing or out of order")
                for x, file in zip(X.LETTERS, files, strict=True):
                    file.write(batch.column(x).to_numpy().astype("<i8").tobytes())
                words, rows = words + len(at), rows + int(batch.column("n").to_numpy().sum())
        finally:
            for file in files:
                file.close()
        return Written(first, words, rows, name)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m and m.words), key=lambda m: m.first)
        at = 0
        for m in parts:
            if m.first != at:
                self.abort(messages)
                raise ValueError(f"words {at} to {m.first} are missing")
            at += m.words
        rows = sum(m.rows for m in parts)
        with created(self.path) as file:
            for word in VERSIONS:
                file.write(struct.pack("<Q", len(word)) + word.encode())
            for x in X.LETTERS:
                file.write(struct.pack("<Q", rows))
                self.parts.append((f"{m.name}-{x}" for m in parts), file)
            file.write(struct.pack("<7Q", *[0] * 7) + struct.pack("<4Q", 0, rows, 0, self.k))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes the tasks' files, those of failed attempts too."""
        self.parts.delete()


def registered(spark: SparkSession) -> SparkSession:
    """spark, with the source kmer_index, and with conditions passed on to it."""
    spark.dataSource.register(IndexSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def metadata(spark: SparkSession, path: str) -> dict:
    """k, rows and more of an index file."""
    return layout(path)


def read_bits(spark: SparkSession, path: str) -> DataFrame:
    """pos, a, c, g, t of an index file."""
    return registered(spark).read.format("kmer_index").load(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(index as operators.index.build() has it, k): k-mers and common suffixes are found from the bits."""
    k = layout(path)["k"]
    return X.from_bits(checkpointed(read_bits(spark, path)), k), k


def write(index: DataFrame, k: int, path: str) -> None:
    """An index with pos, a, c, g, t, as one file. Bits are gathered to words, and tasks write ranges of words."""
    on = lambda x: F.when(F.col(x), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") % 64).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    words = index.groupBy(F.expr("pos div 64").alias("word")).agg(F.count("*").alias("n"), *[F.bit_or(on(x)).alias(x) for x in X.LETTERS])
    words = words.repartitionByRange("word").sortWithinPartitions("word")
    registered(index.sparkSession)
    words.write.format("kmer_index").option("k", k).mode("overwrite").save(path)
