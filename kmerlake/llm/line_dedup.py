"""Line dedup: repeated runs of lines by a suffix array over line ids. DataFrame functions only.

Each document is a sequence of lines, and each line begins a suffix of it. The array is built by prefix doubling over the
suffixes of all documents:

* Lines are ranked by their ids (128-bit hashes, as two longs, since in a very large corpus 64 bits would give some
  different lines one id). To rank suffixes to twice the depth, each gets the pair of its rank and the rank of the suffix
  that begins where its own lines end; pairs are sorted by range partitions, and places in that order are the new ranks.
* Suffixes with one rank are an interval of the array whose longest common prefix has at least that many lines. A suffix
  alone in its interval is settled: no deeper prefix of it repeats. Only intervals of two or more suffixes go on, until
  none is left. Each depth so brackets the common prefix of a suffix and an earlier one (by doc_id, then place).
* The deepest interval in which a suffix comes after another gives a repeated run that begins there. Runs that overlap in a
  document are joined to maximal ones, and their lines are deleted; the first copy of every run stays.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored, texts

MIN_LINES = 2
NO_ID = -(1 << 63)
#: Hashed before a line for the second half of its id.
SECOND = 1
PLACE = ("doc", "key", "at")


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def ranked(suffixes: DataFrame, names: list[str]) -> DataFrame:
    """doc, key, at, rank, later of the suffixes whose names are also another's: places of intervals in the order of names.

    Intervals are counted before they are sorted, so that a name which very many suffixes share is one row. later: whether
    the suffix is not the first of its interval.
    """
    place = F.struct(*PLACE)
    intervals = suffixes.groupBy(*names).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    intervals = intervals.orderBy(*names).select(*names, "first", F.monotonically_increasing_id().alias("name_rank"))
    return suffixes.join(intervals, names).select(*PLACE, F.col("name_rank").alias("rank"), (place != F.col("first")).alias("later"))


def suffix_array(docs: DataFrame, min_lines: int = MIN_LINES) -> Iterator[tuple[int, DataFrame]]:
    """(depth, ranked()) for the depths 1, 2, 4, ... up to min_lines, and from there doubled until no interval is left.

    doc is doc_id, or NO_ID; key is the hash of the text; at is the number, from 0, of a suffix's first line.
    """
    rows = texts(docs).select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), text_key(F.col("text")).alias("key"), F.split("text", "\n").alias("lines"))
    ids = rows.select("doc", "key", F.posexplode(F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(SECOND), x).alias("g")))).alias("at", "id"))
    lines = stored(ids.select(*PLACE, "id.h", "id.g"), "lines")
    now, depth = stored(ranked(lines, ["h", "g"]), "suffixes"), 1
    release(lines)
    while not now.isEmpty():
        yield depth, now
        step = depth if depth >= min_lines else min(depth, min_lines - depth)
        ahead = F.first("rank").over(Window.partitionBy("doc", "key").orderBy("at").rangeBetween(step, step))
        pairs = now.select(*PLACE, "rank", ahead.alias("ahead")).where("ahead is not null")
        now, depth = stored(ranked(pairs, ["rank", "ahead"]), "suffixes"), depth + step


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc, key, starts: sorted places from which `min_lines` lines lie in a repeated run that is not its first copy."""
    levels = [rows.where("later").select(*PLACE, F.lit(depth - min_lines + 1).alias("n")) for depth, rows in suffix_array(docs, min_lines) if depth >= min_lines]
    if not levels:
        return texts(docs).sparkSession.createDataFrame([], "doc bigint, key bigint, starts array<int>")
    runs = levels[0]
    for level in levels[1:]:
        runs = runs.union(level)
    by = Window.partitionBy("doc", "key").orderBy("at")
    reach = F.max(F.col("at") + F.col("n")).over(by)
    runs = runs.select(*PLACE, reach.alias("reach"), F.lead("at").over(by).alias("next"))
    last = F.least("reach", F.coalesce("next", F.col("reach"))) - 1
    starts = runs.where(last >= F.col("at")).select("doc", "key", F.sequence("at", last).alias("part"))
    return starts.groupBy("doc", "key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("part")))).alias("starts"))


def without_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with the kept lines in text, and lines_before, lines_gone, runs_gone (maximal runs of deleted lines), in place of columns of these names.

    Lines end at line feeds only. Runs of blank lines alone are no runs. A null text stays null, with 0 lines; an empty text has one empty
    line. Rows with the same doc_id and text are one document, and stay alike; null doc_ids come before all others.
    """
    docs = docs.drop("lines_before", "lines_gone", "runs_gone")
    runs = repeated_runs(docs, min_lines).toDF("__doc", "__key", "__starts")
    rows = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), "__k": text_key(F.coalesce("text", F.lit("")))})
    rows = rows.join(runs.hint("merge"), (F.col("__d") == F.col("__doc")) & (F.col("__k") == F.col("__key")), "left")
    rows = rows.withColumn("__lines", F.split("text", "\n"))
    full = lambda at: F.exists(F.slice("__lines", at + 1, F.lit(min_lines)), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gone = F.flatten(F.transform(F.filter("__starts", full), lambda at: F.sequence(at, at + (min_lines - 1))))
    rows = rows.withColumn("__gone", F.sort_array(F.array_distinct(gone)))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(keep, lambda i: F.get("__lines", i)), "\n")
    n = F.size("__gone")
    joints = F.size(F.filter(F.zip_with(F.slice("__gone", F.lit(1), n - 1), F.slice("__gone", F.lit(2), n - 1), lambda a, b: b - a == 1), lambda x: x))
    changed = (n > 0) & F.col("text").isNotNull()
    return rows.select(
        *[F.when(changed, kept).otherwise(F.col("text")).alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("bigint").alias("lines_before"),
        F.when(changed, n).otherwise(F.lit(0)).cast("bigint").alias("lines_gone"),
        F.when(changed, n - joints).otherwise(F.lit(0)).cast("bigint").alias("runs_gone"),
    )
