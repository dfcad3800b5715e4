"""Records of sequence files of any size: blocks of lines are parsed apart, and their states composed.

A block is a row (file, block, value): whole lines of a file, and a number that puts the file's blocks in order. The grammar
has nine states between lines: what the last line was (no marker line, a marker, a marker line that is none) and the last
event (none, header, marker). A block maps each state in which it may be entered to the state in which it is left and the
number of records opened; these maps are composed in the order of a file's blocks, first inside splits of the file. Then each
block is parsed from its true state. records() joins sequences that cross a border from their parts; stretches() does not,
so that no row ever holds a sequence of many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.functions import alphabet
from kmerlake.operators.lineage import checkpointed
from kmerlake.operators.windows import in_slices

PLAIN, MARKER, EVEN = 0, 1, 2
NONE, HEADER, PLUS = 0, 1, 2
STATES = [(last, event) for last in (PLAIN, MARKER, EVEN) for event in (NONE, HEADER, PLUS)]
#: Characters of a block that is cut from a file, about.
BLOCK = 1 << 20
#: A block's number is its split's place in the file times this, and a count.
PER_SPLIT = 1 << 20


def after(state: tuple[int, int], kind: str) -> tuple[tuple[int, int], bool]:
    """(next state, opens a record) of a line of kind H, P or O."""
    last, event = state
    quality = last == MARKER
    if kind == "P":
        return ((EVEN, event) if quality else (MARKER, PLUS)), False
    if kind == "H" and not quality:
        return (PLAIN, HEADER), True
    return (PLAIN, event), False


STEPS = {(state, kind): after(state, kind) for state in STATES for kind in "HPO"}
KINDS = {"@": "H", ">": "H", "+": "P"}


def kinds_of(lines: Column) -> Column:
    """One letter, H, P or O, for each line of an array that is not empty."""
    kind = lambda x: F.when(alphabet.is_header(x), "H").when(alphabet.is_marker(x), "P").otherwise("O")
    return F.array_join(F.transform(F.filter(lines, lambda x: x != ""), kind), "")


def read_blocks(spark: SparkSession, paths: str | list[str], size: int = BLOCK) -> DataFrame:
    """Blocks of some `size` characters of files that are split over tasks; their numbers join a split's place in the file and a count."""
    text = spark.read.text(paths, lineSep="\n")
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, done, held, n = None, 0, [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([where[0]]), pa.array([where[1] * PER_SPLIT + done], pa.int64()), pa.array(["\n".join(held)])], ["file", "block", "value"])

        for batch in batches:
            for file, start, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line")), strict=True):
                if (file, start) != where or n >= size:
                    if held:
                        yield block()
                    done = done + 1 if (file, start) == where else 0
                    where, held, n = (file, start), [], 0
                held.append(line)
                n += len(line) + 1
        if held:
            yield block()

    return text.mapInArrow(run, "file string, block bigint, value string")


def block_maps(blocks: DataFrame) -> DataFrame:
    """file, block, leaves, opened: for each state the state in which the block is left, and the records opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, opened = [], []
            for kinds in batch.column("kinds").to_pylist():
                ends = []
                for state in STATES:
                    n = 0
                    for kind in kinds:
                        state, new = STEPS[state, kind]
                        n += new
                    ends.append((STATES.index(state), n))
                leaves.append([s for s, _ in ends])
                opened.append([n for _, n in ends])
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(leaves, pa.list_(pa.int32())), pa.array(opened, pa.list_(pa.int64()))], ["file", "block", "leaves", "opened"])

    kinds = kinds_of(F.split("value", "\n"))
    short = F.regexp_replace(kinds, "OO+", "OO")  # more lines of kind O in a row change nothing
    return blocks.select("file", "block", short.alias("kinds")).mapInArrow(run, "file string, block bigint, leaves array<int>, opened array<bigint>")


def composed(rows: list[dict], state: int) -> tuple[list[tuple[int, int]], int, int]:
    """(state and records before each) of maps in order from a state on, and state and records at the end."""
    base, out = 0, []
    for r in rows:
        out.append((state, base))
        base += r["opened"][state]
        state = r["leaves"][state]
    return out, state, base


def entries(maps: DataFrame) -> DataFrame:
    """file, block, state, base: the state in which each block is entered, and the records opened before it.

    A prefix over the composition of maps in two levels: the blocks of a split of a file make one map, splits' maps are
    composed by file, and blocks then start from the state of their split.
    """

    def whole(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        ends = [composed(rows, state)[1:] for state in range(len(STATES))]
        return pa.table({"file": table.column("file").slice(0, 1), "split": table.column("split").slice(0, 1), "leaves": pa.array([[s for s, _ in ends]], pa.list_(pa.int32())), "opened": pa.array([[n for _, n in ends]], pa.list_(pa.int64()))})

    def of_splits(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["split"])
        found = composed(rows, 0)[0]
        return pa.table({"file": pa.array([r["file"] for r in rows], pa.string()), "split": pa.array([r["split"] for r in rows], pa.int64()), "state": pa.array([s for s, _ in found], pa.int32()), "base": pa.array([n for _, n in found], pa.int64())})

    def of_blocks(table: pa.Table, start: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        found, before = composed(rows, start.column("state")[0].as_py())[0], start.column("base")[0].as_py()
        return pa.table({"file": pa.array([r["file"] for r in rows], pa.string()), "block": pa.array([r["block"] for r in rows], pa.int64()), "state": pa.array([s for s, _ in found], pa.int32()), "base": pa.array([n + before for _, n in found], pa.int64())})

    maps = maps.withColumn("split", F.expr(f"block div {PER_SPLIT}"))
    splits = maps.groupBy("file", "split").applyInArrow(whole, "file string, split bigint, leaves array<int>, opened array<bigint>")
    starts = splits.groupBy("file").applyInArrow(of_splits, "file string, split bigint, state int, base bigint")
    return maps.groupBy("file", "split").cogroup(starts.groupBy("file", "split")).applyInArrow(of_blocks, "file string, block bigint, state int, base bigint")


def parsed(lines: list[str], state: int, seq_no: int) -> Iterator[tuple[int, str, bool]]:
    """(record, text, whole) of a block entered in this state; whole: the record lies in the block from its header to the next."""
    now, parts, opened = STATES[state], [], False
    for line in lines:
        if not line:
            continue
        kind = KINDS.get(line[0], "O")
        if kind == "O" and now[0] != MARKER and now[1] == HEADER:
            parts.append(line)
        now, opens = STEPS[now, kind]
        if opens:
            if parts or opened:
                yield seq_no, "".join(parts), opened
            seq_no, parts, opened = seq_no + 1, [], True
    if parts or opened:
        yield seq_no, "".join(parts), False


def parts_of(blocks: DataFrame) -> DataFrame:
    """file, block, seq_no, part, whole of the records of files in blocks, what parsed() finds, clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "value"):
            row, out = [], []
            columns = (batch.column(c).to_pylist() for c in ("value", "state", "base"))
            for i, (value, state, base) in enumerate(zip(*columns, strict=True)):
                found = list(parsed(value.split("\n"), state, base))
                row += [i] * len(found)
                out += found
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file").take(at), batch.column("block").take(at), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.bool_()), strict=True))],
                ["file", "block", "seq_no", "part", "whole"],
            )

    entered = blocks.join(entries(block_maps(blocks)), ["file", "block"])
    parts = entered.select("file", "block", "value", "state", "base").mapInArrow(run, "file string, block bigint, seq_no bigint, part string, whole boolean")
    return parts.withColumn("part", alphabet.clean(F.col("part")))


def records(blocks: DataFrame, k: int = 0) -> DataFrame:
    """The records of fastx.records(), of files in blocks."""
    parts = parts_of(blocks)
    crossing = parts.where("not whole").groupBy("file", "seq_no").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("p"))
    crossing = crossing.select("file", "seq_no", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("sequence"))
    found = parts.where("whole").select("file", "seq_no", F.col("part").alias("sequence")).union(crossing)
    return found.where((F.length("sequence") >= k) & (F.col("sequence") != ""))


def stretches(blocks: DataFrame, k: int) -> DataFrame:
    """file, seq_no, base, body: the sequences of files in blocks, in stretches that overlap by k - 1 letters, one a block at most.

    Of a sequence that crosses borders only the lengths of its parts and their first k - 1 letters meet: they say where each
    part begins and which letters follow it. Stretches shorter than k, which have no window, are left out.
    """
    parts = checkpointed(parts_of(blocks))
    over = Window.partitionBy("file", "seq_no").orderBy("block")
    heads = parts.where("not whole").select("file", "seq_no", "block", F.length("part").cast("bigint").alias("n"), F.left("part", F.lit(k - 1)).alias("head"))
    behind = over.rowsBetween(1, max(1, k - 1))  # each part but the last ones has a letter
    heads = heads.where("n > 0").select(
        "file", "seq_no", "block", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.left(F.array_join(F.collect_list("head").over(behind), ""), F.lit(k - 1)).alias("tail"),
    )
    crossing = parts.where("not whole").join(heads, ["file", "seq_no", "block"]).select("file", "seq_no", "base", F.concat("part", "tail").alias("body"))
    whole = parts.where("whole").select("file", "seq_no", F.lit(0).cast("bigint").alias("base"), F.col("part").alias("body"))
    return whole.union(crossing).where(F.length("body") >= k)


def read_large(spark: SparkSession, paths: str | list[str], k: int = 0) -> DataFrame:
    """The records of fastx.read_fastx(), for files that are split over tasks."""
    return records(read_blocks(spark, paths), k)


def numbered(blocks: DataFrame) -> DataFrame:
    """file, ln (from 0), line of files in blocks: the lines before a block are a running sum over one row a block."""
    lines = F.split("value", "\n")
    sizes = blocks.select("file", "block", F.size(lines).cast("bigint").alias("n"))
    by = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("base"))
    rows = blocks.join(starts, ["file", "block"]).select("file", "base", F.posexplode(lines).alias("i", "line"))
    return rows.select("file", (F.col("base") + F.col("i")).alias("ln"), "line")
