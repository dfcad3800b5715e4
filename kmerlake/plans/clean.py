"""Cleaning sequence files, and searching them in an index: the plans behind the command line."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.operators import routing, search
from kmerlake.sources import blocks, fastx, sinks


@dataclass
class Job:
    """Inputs and outputs of a run, checked before anything is written."""

    inputs: list[str]
    outputs: list[str]

    def check(self, spark: SparkSession) -> DataFrame:
        """file, size of the inputs; ValueError for empty or unequal lists, repeated, missing or empty files."""
        if not self.inputs or len(self.inputs) != len(self.outputs):
            raise ValueError("as many outputs as inputs are needed, and at least one")
        paths = spark.createDataFrame([(p,) for p in self.inputs + self.outputs], "path string")
        if twice := [r["path"] for r in routing.repeated_paths(paths).collect()]:
            raise ValueError(f"named more than once: {', '.join(sorted(twice))}")
        try:
            sizes = fastx.file_sizes(spark, self.inputs)
        except AnalysisException as error:
            raise ValueError(f"no such file: {error}") from error
        if empty := [r["file"] for r in sizes.where("size = 0").collect()]:
            raise ValueError(f"empty: {', '.join(sorted(empty))}")
        return sizes


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; local ones with one slash after it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:/", system.makeQualified(p).toString())


def clean_files(spark: SparkSession, inputs: list[str], outputs: list[str], k: int) -> DataFrame:
    """Writes for each input a file of its sequences of at least k letters, one a line; returns the streams of files."""
    job = Job(inputs, outputs)
    files = job.check(spark)
    rows = blocks.read_large(spark, inputs, k).withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    sinks.write_sequences(rows, {qualified(spark, i): o for i, o in zip(inputs, outputs, strict=True)})
    return routing.balance(files)


def search_files(spark: SparkSession, inputs: list[str], index: DataFrame, k: int, output: str) -> None:
    """Writes file, seq_no, offset, pos of every k-mer of the inputs; no row holds a sequence of many blocks."""
    found = search.Searcher(index, k).over(blocks.stretches(blocks.read_blocks(spark, inputs), k))
    sinks.write_hits(found, output)
