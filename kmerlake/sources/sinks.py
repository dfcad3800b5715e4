"""Writers of cleaned sequences and search results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from kmerlake.operators.windows import in_slices

from .files import Parts, created


class LineFiles(DataSource):
    """Rows (number, place, line) as text files, a line each; sink "line_files". Option files: the paths, a JSON list, by number.

    Rows are in order by number and place inside tasks, and tasks hold ranges of that order, so that a file is written by as
    many tasks as its rows fill. A commit puts the parts of a file behind one another, or moves its only part to its name.
    """

    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return "number int, place bigint, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LineWriter(json.loads(self.options["files"]))


@dataclass
class Lines(WriterCommitMessage):
    """The parts of a task: (number, first place, name)."""

    parts: list[tuple[int, int, str]] = field(default_factory=list)


class LineWriter(DataSourceArrowWriter):
    def __init__(self, files: list[str]):
        self.files, self.parts = files, Parts(files[0])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Lines:
        said, now, file = Lines(), None, None
        try:
            for batch in in_slices(iterator, "line"):
                numbers = batch.column("number").to_pylist()
                at = 0
                while at < len(batch):
                    end = at + 1
                    while end < len(batch) and numbers[end] == numbers[at]:
                        end += 1
                    if numbers[at] != now:
                        if file:
                            file.close()
                        now, name = numbers[at], uuid.uuid4().hex
                        file = self.parts.create(name)
                        said.parts.append((now, batch.column("place")[at].as_py(), name))
                    file.write(("\n".join(batch.column("line").slice(at, end - at).to_pylist()) + "\n").encode())
                    at = end
        finally:
            if file:
                file.close()
        return said

    def commit(self, messages: list[Lines | None]) -> None:
        own: list[list[tuple[int, str]]] = [[] for _ in self.files]
        for m in messages:
            for number, place, name in m.parts if m else ():
                own[number].append((place, name))
        for path, parts in zip(self.files, own, strict=True):
            names = [name for _, name in sorted(parts)]
            if len(names) == 1:
                self.parts.move(names[0], path)
            else:
                with created(path) as file:
                    self.parts.append(names, file)
        self.parts.delete()

    def abort(self, messages: list[Lines | None]) -> None:
        """Deletes the parts, those of failed attempts too; no output is touched."""
        self.parts.delete()


def write_sequences(records: DataFrame, outputs: dict[str, str]) -> None:
    """One text file for each input file, a sequence a line in input order; an input without a sequence gives an empty file.

    outputs: from each value of records.file to its output path, in one store. Outputs are checked first and must not exist
    twice. All files are written side by side, and a large one by several tasks.
    """
    spark: SparkSession = records.sparkSession
    if len(set(outputs.values())) < len(outputs):
        raise ValueError("two inputs have the same output")
    if not outputs:
        return
    spark.dataSource.register(LineFiles)
    number = spark.createDataFrame([(f, i) for i, f in enumerate(outputs)], "file string, number int")
    rows = records.join(F.broadcast(number), "file").select("number", F.col("seq_no").cast("bigint").alias("place"), F.col("sequence").alias("line"))
    rows = rows.repartitionByRange("number", "place").sortWithinPartitions("number", "place")
    rows.write.format("line_files").option("files", json.dumps(list(outputs.values()))).mode("append").save()


def write_hits(hits: DataFrame, path: str) -> None:
    """file, seq_no, offset, pos as Parquet."""
    hits.select("file", "seq_no", "offset", "pos").write.mode("overwrite").parquet(path)
