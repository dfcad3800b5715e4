"""Index of a set of k-mers: colexicographic places, edge bits, offset map, common suffixes, rank and smaller values.

Rows are (pos, kmer, is_dummy, a, c, g, t, lcs). Dummies, padded by $ on the left, lead to k-mers that no other precedes.
Places follow the letters from the last to the first, with $ < A < C < G < T.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.functions import alphabet

from . import kmers as K
from .lineage import checkpointed
from .order import BLOCK, ranked, running

LETTERS = "acgt"


def node_set(references: DataFrame, k: int) -> DataFrame:
    """kmer, is_dummy: the distinct k-mers of references (file, seq_no, sequence) and their dummies."""
    real = K.kmers(references, k).select("kmer").distinct()
    ends = real.select(F.right("kmer", F.lit(k - 1)).alias("end"))
    sources = real.join(ends, F.left("kmer", F.lit(k - 1)) == F.col("end"), "left_anti")
    prefixes = sources.select("kmer", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("n"))
    dummies = prefixes.select(F.lpad(F.substring("kmer", F.lit(1), F.col("n")), k, "$").alias("kmer"))
    root = references.sparkSession.range(1).select(F.lit("$" * k).alias("kmer"))
    return real.select("kmer", F.lit(False).alias("is_dummy")).union(dummies.union(root).distinct().select("kmer", F.lit(True)))


def backward(k: int) -> list[Column]:
    """Keys that put k-mers in order from their last letters to the first.

    Up to 32 letters they are a packed number, whose highest bits are the last letter, with $ as A, and the number of letters
    that are none: of equal numbers more $ come first. Its sign is turned, so that 64 bits are in order too.
    """
    if k > 32:
        return [F.reverse("kmer")]
    word = alphabet.pack_letters(F.translate("kmer", "$", "A"))
    return [word.bitwiseXOR(F.lit(-(1 << 63))), F.length(F.ltrim("kmer", F.lit("$")))]


def build(references: DataFrame, k: int) -> DataFrame:
    """The index of all k-mers of references."""
    nodes = ranked(node_set(references, k), *backward(k))
    first = F.row_number().over(Window.partitionBy(F.right("kmer", F.lit(k - 1))).orderBy("pos")) == 1
    suffix = F.right("kmer", F.lit(k - 1)).alias("suffix")
    edges = nodes.where(F.col("kmer") != "$" * k).groupBy(F.left("kmer", F.lit(k - 1)).alias("suffix")).agg(
        *[F.max(F.right("kmer", F.lit(1)) == x.upper()).alias(x) for x in LETTERS]
    )
    rows = nodes.select("pos", "kmer", "is_dummy", suffix, first.alias("first")).join(edges, "suffix", "left")
    rows = rows.select("pos", "kmer", "is_dummy", *[(F.col("first") & F.coalesce(x, F.lit(False))).alias(x) for x in LETTERS])
    return with_common_suffixes(rows, nodes, k)


def with_common_suffixes(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """rows (pos, kmer, ...) with lcs: the last letters, no $ among them, that a row has in common with the one above (pos, kmer in nodes), k - 1 at most."""
    above = nodes.select((F.col("pos") + 1).alias("pos"), F.reverse("kmer").alias("above"))
    rows = rows.withColumn("back", F.reverse("kmer")).join(above, "pos", "left")
    same = F.lit(0)
    step = 1 << max(0, (k - 1).bit_length() - 1)
    while step:  # the longest common length, bit by bit
        more = same + step
        agree = (F.left("back", more) == F.left("above", more)) & (F.instr(F.left("back", more), F.lit("$")) == 0) & (more <= k - 1)
        rows = rows.withColumn("same", same + F.when(F.coalesce(agree, F.lit(False)), step).otherwise(0))
        same, step = F.col("same"), step // 2
    return rows.withColumn("lcs", same).drop("back", "above", "same")


def from_bits(bits: DataFrame, k: int) -> DataFrame:
    """The index, as build() has it, from its rows' bits alone (pos, a, c, g, t), as an index file keeps them.

    The rows in order of their letter and of the bit that leads to them are the targets of the set bits, so each row's last
    letter and the row before it follow from ranks. Letters further back are those of rows before, gathered by pointer
    doubling: in each round the texts of a row and of the row as many steps before are joined.
    """
    start = {r["letter"].lower(): r["offset"] for r in offset_map(bits).collect()}
    counted = ranks(bits)
    edges = [counted.where(x).select((F.col(f"rank_{x}") + start[x]).alias("pos"), F.col("pos").alias("before"), F.lit(x.upper()).alias("text")) for x in LETTERS]
    root = bits.where("pos = 0").select("pos", F.col("pos").alias("before"), F.lit("$").alias("text"))
    rows, n = checkpointed(reduce(DataFrame.union, edges, root)), 1
    while n < k:
        behind = rows.select(F.col("pos").alias("before"), F.col("before").alias("further"), F.col("text").alias("left"))
        rows = checkpointed(rows.join(behind, "before").select("pos", F.col("further").alias("before"), F.concat("left", "text").alias("text")))
        n *= 2
    kmers = rows.select("pos", F.right("text", F.lit(k)).alias("kmer"))
    found = bits.join(kmers, "pos").select("pos", "kmer", F.contains("kmer", F.lit("$")).alias("is_dummy"), *LETTERS)
    return with_common_suffixes(found, kmers, k)


def offset_map(index: DataFrame) -> DataFrame:
    """letter, offset: where the rows that end in a letter begin; the end of all rows as 'end'."""
    counts = index.agg(*[F.sum(F.col(x).cast("bigint")).alias(x) for x in LETTERS])
    before = lambda n: reduce(lambda s, x: s + F.coalesce(F.col(x), F.lit(0)), LETTERS[:n], F.lit(1).cast("bigint"))
    rows = [F.struct(F.lit(n).alias("letter"), before(i).alias("offset")) for i, n in enumerate((*LETTERS.upper(), "end"))]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.letter", "r.offset")


def ranks(index: DataFrame) -> DataFrame:
    """index with rank_a, rank_c, rank_g, rank_t: ones strictly above each row."""
    return running(index, {f"rank_{x}": F.col(x).cast("bigint") for x in LETTERS})


def rank_blocks(index: DataFrame, letter: str, wide: bool = True) -> DataFrame:
    """block, layer_0 (ones before its 2 ** 32 bits; without wide none), layer_1 (ones in these before the block), layer_1_2
    (packed with the ones of its first three quarters), ones: the rank directory of one bit vector, blocks of 1024 bits."""
    on = F.col(letter).cast("bigint")
    quarter = F.expr("(pos % 1024) div 256")
    blocks = index.groupBy(F.expr("pos div 1024").alias("block")).agg(
        F.sum(on).alias("ones"), *[F.sum(F.when(quarter == i, on).otherwise(0)).alias(f"q{i}") for i in range(3)]
    )
    blocks = running(blocks, {"before": F.col("ones")}, "block")
    blocks = blocks.withColumn("hyper", F.expr("block div 4194304"))
    starts = blocks.groupBy("hyper").agg(F.min("before").alias("start"))
    blocks = blocks.join(starts, "hyper")
    layer_1 = F.col("before") - F.col("start") if wide else F.col("before")
    word = F.call_function("shiftleft", layer_1, F.lit(32)).bitwiseOR(F.call_function("shiftleft", F.col("q0"), F.lit(20)))
    word = word.bitwiseOR(F.call_function("shiftleft", F.col("q1"), F.lit(10))).bitwiseOR(F.col("q2"))
    return blocks.select("block", (F.col("start") if wide else F.lit(0).cast("bigint")).alias("layer_0"), layer_1.alias("layer_1"), word.alias("layer_1_2"), "ones")


def nearest_smaller(lcs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest place before it, or -1, and after it, or the length, with a smaller value: a pass for each value up to k."""
    n = len(lcs)
    place = np.arange(n)
    before, after = np.full(n, -1), np.full(n, n)
    for v in range(k + 1):
        at = np.flatnonzero(lcs == v)
        if len(at):
            smaller = lcs < v
            before[at] = np.maximum.accumulate(np.where(smaller, place, -1))[at]
            after[at] = np.minimum.accumulate(np.where(smaller, place, n)[::-1])[::-1][at]
    return before, after


def smaller_values(index: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """pos, lcs, psv, nsv: the nearest rows above and below with a smaller lcs; 0 and the number of rows where none is.

    Inside blocks of rows by whole columns; from other blocks by running extremes over one row a block.
    """
    rows = index.select("pos", F.col("lcs").cast("int").alias("lcs"), F.expr(f"pos div {block}").alias("b"))
    place = lambda v: F.when(F.col("lcs") < v, F.col("pos"))
    per = rows.groupBy("b").agg(F.count("*").alias("n"), F.array(*[F.max(place(v)) for v in range(1, k + 1)]).alias("hi"), F.array(*[F.min(place(v)) for v in range(1, k + 1)]).alias("lo"))
    above, below = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    all_rows = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.sum("n").over(all_rows)
    up = F.array(*[F.coalesce(F.max(F.col("hi")[v]).over(above), F.lit(0)) for v in range(k)])
    down = F.array(*[F.coalesce(F.min(F.col("lo")[v]).over(below), size) for v in range(k)])
    per = per.select(F.col("b").alias("block"), up.alias("up"), down.alias("down"), size.alias("size"))

    def run(key, inside: pa.Table, outside: pa.Table) -> pa.Table:
        inside = inside.sort_by("pos")
        pos, lcs = inside.column("pos").to_numpy(), inside.column("lcs").to_numpy()
        up, down = (np.array(outside.column(c)[0].as_py()) for c in ("up", "down"))
        before, after = nearest_smaller(lcs, k)
        none = lcs < 1  # nothing is smaller
        far = np.maximum(lcs - 1, 0)
        psv = np.where(none, 0, np.where(before >= 0, pos[np.maximum(before, 0)], up[far]))
        nsv = np.where(none, outside.column("size")[0].as_py(), np.where(after < len(pos), pos[np.minimum(after, len(pos) - 1)], down[far]))
        return pa.table({"pos": pos, "lcs": lcs, "psv": psv, "nsv": nsv})

    return rows.groupBy("b").cogroup(per.groupBy("block")).applyInArrow(run, "pos bigint, lcs int, psv bigint, nsv bigint")


def suffix_intervals(index: DataFrame, m: int) -> DataFrame:
    """suffix, l, r: the rows that end in each text of m letters."""
    rows = index.where(F.instr(F.right("kmer", F.lit(m)), F.lit("$")) == 0)
    return rows.groupBy(F.right("kmer", F.lit(m)).alias("suffix")).agg(F.min("pos").alias("l"), F.max("pos").alias("r"))


def info(index: DataFrame, k: int) -> DataFrame:
    """One row about an index: bits, k, where letters begin, and the lengths of the rank directory's layers."""
    sums = [F.sum(F.col(x).cast("bigint")) for x in LETTERS]
    offsets = [reduce(lambda s, x: s + x, sums[:i], F.lit(1).cast("bigint")).cast("string") for i in range(5)]
    n = F.count("*")
    return index.agg(
        n.alias("num_bits"), F.lit(k).alias("k"), F.concat_ws(" ", *offsets).alias("c_map"),
        F.ceil(n / (1 << 32)).alias("layer_0_len"), F.ceil(n / 1024).alias("layer_1_2_len"),
    )
