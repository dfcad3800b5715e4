"""Files that arrive over time: each is cleaned, and searched if an index is given, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kmerlake.operators import search
from kmerlake.sources import blocks

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def clean_arrivals(spark: SparkSession, folder: str, output: str, checkpoint: str, k: int, index: DataFrame | None = None, once: bool = False, files: int = 1000) -> StreamingQuery:
    """Appends records, or with an index hits, of new files in folder to Parquet; batches that are run again overwrite themselves.

    The stream is of names, `files` a batch at most; each batch reads its files in blocks, so that a file may be of any size.
    The index is prepared once.
    """
    names = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files).load(folder).select("path")
    searcher = search.Searcher(index, k) if index is not None else None

    def put(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # `files` at most
        if not paths:
            return
        if searcher is None:
            rows = blocks.read_large(spark, paths, k)
        else:
            rows = searcher.over(blocks.stretches(blocks.read_blocks(spark, paths), k))
        rows.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = names.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
