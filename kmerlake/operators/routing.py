"""Files into streams, checks of paths, order of output."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .order import BLOCK, ranked, running

STREAM = 20 * 1024 * 1024


def balance(files: DataFrame, limit: int = STREAM, block: int = BLOCK) -> DataFrame:
    """file, size, stream, stream_total: files by size, ascending (ties by name), fill a stream until its total exceeds limit.

    Streams are numbered from 0, largest total first, ties by filling order. Where a stream begins depends on each stream
    before. Each file has a link to the first file past the limit of a stream that would begin with it; the begins are what
    the links reach from the first file. Links are followed to the end of their block of `block` files first; then links out
    of blocks are doubled until all blocks that are met are known, in as many joins as the number of blocks has bits.
    """
    placed = ranked(files.select("file", F.col("size").cast("bigint").alias("size")), F.col("size"), F.col("file"), name="i")
    rows = checkpointed(running(placed, {"before": F.col("size")}, "i"))
    n = rows.count()
    jumps = checkpointed(_links(rows, limit, n).groupBy(F.expr(f"i div {block}")).applyInArrow(lambda t: _out_of_block(t, block), "i bigint, next bigint, exit bigint"))
    entries = _reached(jumps.select("i", F.col("exit").alias("to")), n, -(-n // block)).select(F.col("i").alias("entry"), F.expr(f"i div {block}").alias("entered"))
    links = jumps.select("i", "next", F.expr(f"i div {block}").alias("b"))
    begins = links.groupBy("b").cogroup(entries.groupBy("entered")).applyInArrow(_walk, "i bigint, begins boolean")
    bins = running(begins, {"bin": F.col("begins")}, "i").select("i", (F.col("bin") + F.col("begins").cast("bigint") - 1).alias("bin"))
    rows = rows.select("i", "file", "size").join(bins, "i")
    totals = rows.groupBy("bin").agg(F.sum("size").alias("stream_total"))
    order = ranked(totals, -F.col("stream_total"), F.col("bin"), name="stream")
    return rows.join(order, "bin").select("file", "size", F.col("stream").cast("int").alias("stream"), "stream_total")


def _links(rows: DataFrame, limit: int, n: int) -> DataFrame:
    """i, next: the file after the first one with which a stream that begins with file i exceeds limit; n where none does.

    The sums at which files end and those that streams may reach are put in one order, so that the files that end below a
    limit are counted by their places.
    """
    ends = rows.select((F.col("before") + F.col("size")).alias("value"), F.lit(0).alias("kind"), "i")
    limits = rows.select((F.col("before") + limit).alias("value"), F.lit(1).alias("kind"), "i")
    both = ranked(ends.union(limits), F.col("value"), F.col("kind"), F.col("i"), name="place")
    return both.where("kind = 1").select("i", F.least(F.col("place") - F.col("i") + 1, F.lit(n)).cast("bigint").alias("next"))


def _out_of_block(table: pa.Table, block: int) -> pa.Table:
    """i, next, exit: where the links from each file of a block first leave it."""
    table = table.sort_by("i")
    i, to = table.column("i").to_numpy(), table.column("next").to_numpy()
    low, exit_ = int(i[0]), to.copy()
    end = low - low % block + block
    while (inside := np.flatnonzero(exit_ < min(end, low + len(i)))).size:
        exit_[inside] = exit_[exit_[inside] - low]
    return pa.table({"i": i, "next": to, "exit": exit_})


def _reached(links: DataFrame, n: int, blocks: int) -> DataFrame:
    """i of the files that links (i, to) reach from the first one."""
    found = links.where("i = 0").select("i")
    for _ in range(max(0, blocks - 1).bit_length()):
        further = found.join(links, "i").select(F.col("to").alias("i")).where(F.col("i") < n)
        found = checkpointed(found.union(further).distinct())
        twice = links.select(F.col("i").alias("to"), F.col("to").alias("then"))
        links = checkpointed(links.join(twice, "to", "left").select("i", F.coalesce("then", "to").alias("to")))
    return found


def _walk(links: pa.Table, entry: pa.Table) -> pa.Table:
    """i, begins: which files of a block begin a stream, if one of them is reached from before."""
    links = links.sort_by("i")
    i, to = links.column("i").to_numpy(), links.column("next").to_numpy()
    begins = np.zeros(len(i), bool)
    at = int(entry.column("entry")[0].as_py()) - int(i[0]) if len(entry) else len(i)
    while at < len(i):
        begins[at] = True
        at = int(to[at]) - int(i[0])
    return pa.table({"i": i, "begins": begins})


def repeated_paths(paths: DataFrame) -> DataFrame:
    """path, n of paths that are named more than once."""
    return paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
