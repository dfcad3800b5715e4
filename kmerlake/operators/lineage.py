"""Tables in the folder that driver and executors share: cutting lineage, and deleting what no later step reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a new local one only where none is set and all runs in one process."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='kmerlake-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df from the shared checkpoint folder, with its lineage cut there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Paths of stored tables, by scope from the outermost to the innermost that is open.
_open: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables that are stored inside are deleted at its end, on success and on failure; results must be written before.

    with scope():
        near_duplicates(docs).write.parquet(path)
    """
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            _delete(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append((spark, path))
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by stored() that no later step reads."""
    _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
