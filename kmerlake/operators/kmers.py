"""Filters, segments and k-mers of records (file, seq_no, sequence)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.functions import alphabet

from .lineage import checkpointed
from .order import running
from .windows import CODES, cut_rows, ordered_windows, texts

SEGMENT = 128


def long_enough(records: DataFrame, k: int) -> DataFrame:
    """Records of at least k letters; stands below every explode, so that short ones never multiply."""
    return records.where(F.length("sequence") >= k)


def kmer_totals(records: DataFrame, k: int) -> DataFrame:
    """file, sequences, kmers of records of at least k letters."""
    kept = long_enough(records, k)
    return kept.groupBy("file").agg(F.count("*").alias("sequences"), F.sum((F.length("sequence") - (k - 1)).cast("bigint")).alias("kmers"))


def segments(records: DataFrame, k: int, size: int = SEGMENT) -> DataFrame:
    """file, seq_no, seg_no, seg_start, seg_end, is_true_sep.

    While at least 2 * size letters are pending a segment of `size` is cut; more than `size` left at the end are halved, the
    shorter half first. Only the last segment of a sequence is a true separator.
    """
    rows = long_enough(records, k).select("file", "seq_no", F.length("sequence").cast("bigint").alias("n"), F.posexplode(F.arrays_zip(*segment_bounds(size))).alias("seg_no", "s"))
    return rows.select("file", "seq_no", "seg_no", "s.seg_start", "s.seg_end", (F.col("s.seg_end") == F.col("n")).alias("is_true_sep"))


def segment_bounds(size: int) -> tuple[Column, Column]:
    """seg_start, seg_end: arrays of where the segments of sequence begin and end."""
    n = F.length("sequence").cast("bigint")
    cuts = F.greatest(F.lit(0), F.expr(f"cast(length(sequence) as bigint) div {size}") - 1)
    rest = n - cuts * size
    none = F.array().cast("array<bigint>")
    whole = F.when(cuts > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), cuts), lambda i: i * size)).otherwise(none)
    inner = F.concat(whole, F.when(rest > size, F.array(cuts * size + F.floor(rest / 2))).otherwise(none))
    return F.concat(F.array(F.lit(0).cast("bigint")), inner).alias("seg_start"), F.concat(inner, F.array(n)).alias("seg_end")


def separators(segs: DataFrame, k: int) -> DataFrame:
    """segs with begin (place of the segment in its file's packed letters), true_before (rank of true separators) and
    out_start (place of its first k-mer in its file's output)."""
    sums = {"begin": F.col("seg_end") - F.col("seg_start"), "true_before": F.col("is_true_sep")}
    rows = running(segs, sums, "seq_no", within=("file",), then=("seg_no",))
    return rows.withColumn("out_start", F.col("begin") - F.col("true_before") * (k - 1))


def stretches(records: DataFrame, k: int, stretch: int, more: tuple[str, ...] = ()) -> DataFrame:
    """file, seq_no, more columns, begin, body: sequences in stretches of `stretch` windows, which overlap by k - 1 letters.

    So no array of windows gets long, and a window is found in few steps. A row is read once from its begin to its end: it is
    cut into blocks of `stretch` letters, and each gets the first letters of the blocks behind it.
    """
    kept = long_enough(records, k)
    blocks = F.when(F.length("sequence") < stretch + k, F.array("sequence")).otherwise(F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{stretch}}}"), F.lit(0)))
    kept = kept.select("file", "seq_no", *more, blocks.alias("blocks"))
    behind = -(-(k - 1) // stretch)  # blocks that hold the overlap
    if behind:
        later = [F.slice("blocks", F.lit(i + 1), F.size("blocks")) for i in range(1, behind + 1)]
        tails = later[0]
        for further in later[1:]:
            tails = F.zip_with(tails, further, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        bodies = F.zip_with("blocks", tails, lambda a, b: F.concat(a, F.left(F.coalesce(b, F.lit("")), F.lit(k - 1))))
    else:
        bodies = F.col("blocks")
    parts = kept.select("file", "seq_no", *more, F.posexplode(bodies).alias("part", "body"))
    return parts.where(F.length("body") >= k).select("file", "seq_no", *more, (F.col("part").cast("bigint") * stretch).alias("begin"), "body")


def kmers(records: DataFrame, k: int, stretch: int = 128, more: tuple[str, ...] = ()) -> DataFrame:
    """file, seq_no, more columns, offset, kmer: every window of k letters."""
    parts = stretches(records, k, stretch, more)
    windows = F.transform(F.sequence(F.lit(1), F.length("body") - (k - 1)), lambda i: F.substring(F.col("body"), i, F.lit(k)))
    return parts.select("file", "seq_no", *more, "begin", F.posexplode(windows).alias("i", "kmer")).select("file", "seq_no", *more, (F.col("begin") + F.col("i")).alias("offset"), "kmer")


#: Letters of a sequence up to which its k-mers are summed up in one piece.
WHOLE = 1 << 20


def kmer_summaries(records: DataFrame, k: int, whole: int = WHOLE) -> DataFrame:
    """file, seq_no, kmers, distinct_kmers, least, greatest, offsets (their sum) of the k-mers of each file and seq_no.

    A sequence that lies in one row is summed up there, as packed numbers, and no k-mer is exchanged. Those of several rows, of
    over `whole` letters or with letters that are none are summed up from rows of k-mers; their keys are counted first.
    """
    if k > 32:
        return _exchanged(kmers(records, k))
    rows = long_enough(records, k).select("file", "seq_no", F.lit(0).cast("bigint").alias("base"), F.col("sequence").cast("binary").alias("body"))
    parts = checkpointed(rows.mapInArrow(lambda batches: _summed(batches, k, whole), "file string, seq_no bigint, kmers bigint, distinct_kmers bigint, least string, greatest string, offsets bigint"))
    open_keys = checkpointed(parts.groupBy("file", "seq_no").agg(F.count("*").alias("n"), F.count("least").alias("settled")).where("n > 1 or settled = 0").selectExpr("file as __file", "seq_no as __seq_no"))
    if open_keys.isEmpty():
        return parts
    same = F.col("file").eqNullSafe(F.col("__file")) & F.col("seq_no").eqNullSafe(F.col("__seq_no"))
    return parts.join(open_keys, same, "left_anti").union(_exchanged(kmers(records.join(open_keys, same, "left_semi"), k)))


def _summed(batches: Iterator[pa.RecordBatch], k: int, whole: int) -> Iterator[pa.RecordBatch]:
    """A row of kmer_summaries() for each row of cut_rows(); least is null where it has letters that are none."""
    for batch in cut_rows(batches, k, whole):
        n = np.array([len(x.as_buffer()) for x in batch.column("body")], np.int64)
        codes = CODES[np.frombuffer(b"".join(batch.column("body").to_pylist()), np.uint8)]
        number, start, many = ordered_windows(codes & 3, k), n.cumsum() - n, n - (k - 1)
        good = np.add.reduceat(codes > 3, start, dtype=np.int64) == 0
        distinct, ends = np.zeros(len(n), np.int64), np.zeros((2, len(n)), np.uint64)
        for i, (at, size) in enumerate(zip(start.tolist(), many.tolist(), strict=True)):
            own = np.sort(number[at : at + size])
            distinct[i], ends[0, i], ends[1, i] = 1 + np.count_nonzero(own[1:] != own[:-1]), own[0], own[-1]
        offsets = many * batch.column("base").to_numpy() + many * (many - 1) // 2
        least, greatest = (texts(x, k).filter(pa.array(good)).take(pa.array(good.cumsum() - 1, mask=~good)) for x in ends)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("seq_no"), *map(pa.array, (many, distinct)), least, greatest, pa.array(offsets)], ["file", "seq_no", "kmers", "distinct_kmers", "least", "greatest", "offsets"])


def _exchanged(windows: DataFrame) -> DataFrame:
    """kmer_summaries() of rows of k-mers: equal ones are counted first, which needs no order."""
    once = windows.groupBy("file", "seq_no", "kmer").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))
    return once.groupBy("file", "seq_no").agg(
        F.sum("n").alias("kmers"), F.count("*").alias("distinct_kmers"), F.min("kmer").alias("least"), F.max("kmer").alias("greatest"), F.sum("offsets").alias("offsets")
    )


def segment_texts(size: int) -> Column:
    """The segments of sequence, as segment_bounds() has them, cut in one pass."""
    n = F.length("sequence")
    cuts = F.greatest(F.lit(0), F.expr(f"length(sequence) div {size}") - 1).cast("int")
    rest = F.substring("sequence", cuts * size + 1, n)
    half = F.expr(f"(length(sequence) - greatest(0, length(sequence) div {size} - 1) * {size}) div 2").cast("int")
    last = F.when(n - cuts * size > size, F.array(F.left(rest, half), F.substring(rest, half + 1, n))).otherwise(F.array(rest))
    return F.concat(F.regexp_extract_all(F.left("sequence", cuts * size), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), last)


def decoded(records: DataFrame, k: int, size: int = SEGMENT) -> DataFrame:
    """file, seq_no, line: each sequence of at least k letters, decoded from the packed words of its segments.

    A segment is packed into words of 32 letters, of which the last may be part empty, and unpacked to as many letters as it
    has; a sequence's segments are joined in its row. Lines are in order by seq_no: a file in one string would be bounded by
    the largest string.
    """
    packed = F.transform(segment_texts(size), lambda s: F.struct(alphabet.pack_words(s).alias("words"), F.length(s).alias("n")))
    rows = long_enough(records, k).select("file", "seq_no", packed.alias("segments"))
    return rows.select("file", "seq_no", F.array_join(F.transform("segments", lambda s: alphabet.unpack_words(s["words"], s["n"])), "").alias("line"))
