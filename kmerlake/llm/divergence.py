"""Audit of how sources differ in their terms: sketch-prefiltered counts, then sparse joins of pairs.

1. Sketch. Every task counts in how many of its documents each term of a language occurs, and adds these numbers, never
   above the threshold, to a count-min sketch of DEPTH rows of cells. It sends its cells that are not 0, in blocks; blocks
   are merged in two levels by adding and cutting off at the threshold. A merged cell is never below a term's true
   document frequency, so a term with a cell below the threshold is impossible. One bit a cell is what tasks get.
2. Exact counts. Tasks read the texts again, count each (language, source, term) themselves, discard impossible terms, and
   only then shuffle one row for each term that is left. Document frequencies are exact from here on.
3. Pairs. Most terms do not occur in most sources, and such a term's estimate is the same number in a source for all of
   them. So a pair's sum of differences is taken as if no term occurred in either; then what the terms of one source
   change against that of the other is added, by a table of the numbers that a source's estimates take; and last what the
   terms in both change, from a join of occurring terms only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents of a language that a term must occur in.
LEAST = 30
TOP = 50
DEPTH = 4
#: Cells of a row of the sketch: so many for each document, a power of two within these bounds. The upper one bounds what is broadcast to 32 MB.
PER_DOCUMENT, FEWEST, MOST = 32, 1 << 16, 1 << 26
#: Cells of a block in which sketches are sent and merged.
BLOCK = 1 << 16
#: Terms that a task holds before it sends what it has.
HELD = 400_000
#: Parts in which a block's cells are merged first.
PARTS = 64
#: What is no term becomes a blank; ASCII capitals become small letters; all other bytes are parts of terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def inputs(docs: DataFrame) -> DataFrame:
    """lang, source, text of every row; null: empty."""
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[bytes]]]:
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            yield lang, source, terms(bytes(text.as_buffer()))


def cells_of(lang: str, words: list[bytes], width: int) -> np.ndarray:
    """The cells of terms of a language: a row for each term, a column for each row of the sketch."""
    seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    one = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)
    step = (one >> np.uint64(32)) | np.uint64(1)
    rows = np.arange(DEPTH, dtype=np.uint64)
    return ((one[:, None] + rows * step[:, None]) % np.uint64(width) + rows * np.uint64(width)).astype(np.int64)


def added(cells: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Different cells in order and the sums of their counts, cut off at least."""
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    begin = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    return cells[begin], np.minimum(np.add.reduceat(counts, begin), least) if len(cells) else counts


def packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    return cells.astype("<u2").tobytes() + counts.astype("<u2").tobytes()


def merged(column: pa.ChunkedArray, least: int) -> np.ndarray:
    """A block's cells, added and cut off at least."""
    out = np.zeros(BLOCK, np.int64)
    for x in column:
        at, counts = np.frombuffer(x.as_buffer(), "<u2").reshape(2, -1)
        out[at] += counts
    return np.minimum(out, least)


class Sketch:
    """Which cells reach the threshold, one bit each."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.width = bits, width

    def possible(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Which terms may be in enough documents; never false for one that is."""
        cells = cells_of(lang, words, self.width)
        return (self.bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).all(1)


def sketch(docs: DataFrame, least: int = LEAST, width: int | None = None) -> Sketch:
    """The merged sketch of the document frequencies of terms of inputs()."""
    if least > 65535:
        raise ValueError("counts are kept in 16 bits")
    if width is None:
        wanted = PER_DOCUMENT * docs.count()
        width = min(MOST, max(FEWEST, 1 << (wanted - 1).bit_length() if wanted else FEWEST))
    if width % BLOCK:
        raise ValueError(f"width must be a multiple of {BLOCK}")

    def send(seen: dict[str, Counter]) -> pa.RecordBatch:
        cells = np.concatenate([cells_of(lang, list(c), width).ravel() for lang, c in seen.items()])
        counts = np.concatenate([np.repeat(np.fromiter(c.values(), np.int64, len(c)), DEPTH) for c in seen.values()])
        cells, counts = added(cells, np.minimum(counts, least), least)
        cut = np.flatnonzero(np.r_[True, cells[1:] // BLOCK != cells[:-1] // BLOCK])
        parts = zip(np.split(cells, cut[1:]), np.split(counts, cut[1:]), strict=True)
        rows = [(int(a[0] // BLOCK), packed(a % BLOCK, b)) for a, b in parts]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for lang, _, words in groups_of(batches):
            if words:
                seen.setdefault(lang, Counter()).update(set(words))
                if sum(map(len, seen.values())) > HELD:
                    yield send(seen)
                    seen = {}
        if seen:
            yield send(seen)

    def part(table: pa.Table) -> pa.Table:
        sums = merged(table.column("body"), least)
        at = np.flatnonzero(sums)
        return pa.table({"block": table.column("block").slice(0, 1), "body": pa.array([packed(at, sums[at])], pa.binary())})

    def whole(table: pa.Table) -> pa.Table:
        full = merged(table.column("body"), least) >= least
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())})

    sent = docs.mapInArrow(run, "block int, body binary").withColumn("part", F.spark_partition_id() % PARTS)
    parts = sent.groupBy("block", "part").applyInArrow(part, "block int, body binary")
    bits = np.zeros(DEPTH * width // 8, np.uint8)
    for r in parts.groupBy("block").applyInArrow(whole, "block int, bits binary").collect():  # a bit for each cell
        bits[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return Sketch(bits, width)


def counted(docs: DataFrame, held: Sketch) -> DataFrame:
    """lang, source, term, n, df of the terms of inputs() that are possible: occurrences and documents, exact."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def send(seen: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        asked: dict[str, set] = {}
        for (lang, _), (_, df) in seen.items():
            asked.setdefault(lang, set()).update(df)
        kept = {}
        for lang, words in asked.items():
            own = list(words)
            kept[lang] = {own[i] for i in np.flatnonzero(shared.value.possible(lang, own))} if own else set()
        for (lang, source), (n, df) in seen.items():
            own = [w for w in df if w in kept[lang]]
            if own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[w] for w in own], pa.int64()), pa.array([df[w] for w in own], pa.int64())],
                    ["lang", "source", "term", "n", "df"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for lang, source, words in groups_of(batches):
            n, df = seen.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            df.update(set(words))
            if sum(len(x) for _, x in seen.values()) > HELD:
                yield from send(seen)
                seen = {}
        yield from send(seen)

    sent = docs.mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: str, total: str, kinds: str):
    """1 + floor(10**9 * (n + 5) / (total + 5 * kinds)), exact; null without terms."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 5 as decimal(19,0))) div cast(nullif({total} + 5 * {kinds}, 0) as decimal(19,0))")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, width: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms.

    part `pair`: item is another source of the language and value the sum, over all terms kept for the language, of the
    differences of both estimates; part `term`: item is a term that the source has and uses more than the language, value by
    how much, the first `top` only. Terms are runs of ASCII letters, of which capitals count as small ones, and of characters
    beyond ASCII; kept are those in at least `least` rows of the language. Null lang, source and text are empty texts.
    Repeated rows count each. A group without terms has pairs too; they are 0 if its language keeps no term. An empty table
    gives no rows. Other columns of docs are not read.
    """
    rows = inputs(docs)
    counts = stored(counted(rows, sketch(rows, least, width)), "term-counts")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("lang_df")).where(F.col("lang_df") >= least).drop("lang_df"), "kept-terms")
    found = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "found-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["kinds", "lang_total", "total"])
    sources = stored(sources.select("*", share("0", "total", "kinds").alias("none")), "sources")
    own = found.join(sources, ["lang", "source"]).select("lang", "source", "term", "none", share("n", "total", "kinds").alias("p"), share("lang_n", "lang_total", "kinds").alias("q"))
    own = stored(own, "estimates")

    other = sources.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    pair = [F.least("source", "other").alias("one"), F.greatest("source", "other").alias("two")]
    apart = sources.join(other, "lang").where("source < other").select("lang", *pair, (F.col("kinds") * F.coalesce(gap("none", "other_none"), F.lit(0))).alias("value"))
    levels = own.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("m"))
    alone = levels.join(other, "lang").where("source <> other").select("lang", *pair, (F.col("m") * (gap("p", "other_none") - gap("none", "other_none"))).alias("value"))
    right = own.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("none").alias("other_none"))
    both = own.join(right, ["lang", "term"]).where("source < other")
    both = both.select("lang", *pair, (gap("p", "other_p") - gap("p", "other_none") - gap("other_p", "none") + gap("none", "other_none")).alias("value"))
    sums = apart.union(alone).union(both).groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    pairs = sums.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    more = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.select("*", rank).union(more.select("*", rank).where(F.col("rank") <= top))
