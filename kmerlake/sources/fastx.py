"""Sequence records from FASTA and FASTQ text, by the engine's own functions; files are read by blocks.py.

A record is (file, seq_no, sequence): headers are dropped, the lines of a sequence are joined, and anything but A, C, G
and T becomes A. Lines end at line feeds only. Grammar, by lines that are not empty: H begins with @ or >, P with +, O is
any other. In each run of P lines the odd ones are markers; the line after a marker is quality, whatever it begins with.
An H line that is no quality opens a record; O lines belong to it until the next header or marker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.functions import alphabet


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths, one a line; blank lines do not count."""
    return spark.read.text(path, lineSep="\n").select(F.col("value").alias("path")).where("path <> ''")


def file_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, size in bytes, without reading the contents."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("size"))


def lines(raw: DataFrame) -> DataFrame:
    """file, ln (from 0), line of whole texts."""
    return raw.select("file", F.posexplode(F.split("value", "\n")).alias("ln", "line"))


def records(raw: DataFrame, k: int = 0) -> DataFrame:
    """Records of whole texts (file, value) whose sequences have at least k letters.

    One shuffle by file; all windows share its order.
    """
    kind = F.when(alphabet.is_header(F.col("line")), "H").when(alphabet.is_marker(F.col("line")), "P").otherwise("O")
    rows = lines(raw).where("line <> ''").withColumn("kind", kind)
    by = Window.partitionBy("file").orderBy("ln")
    rows = rows.withColumn("last_other", F.last(F.when(F.col("kind") != "P", F.col("ln")), True).over(by))
    rows = rows.withColumn("row", F.row_number().over(by))
    rows = rows.withColumn("row_other", F.last(F.when(F.col("kind") != "P", F.col("row")), True).over(by))
    marker = (F.col("kind") == "P") & ((F.col("row") - F.coalesce("row_other", F.lit(0))) % 2 == 1)
    rows = rows.withColumn("quality", F.coalesce(F.lag(marker).over(by), F.lit(False)))
    opens = (F.col("kind") == "H") & ~F.col("quality")
    event = F.when(~F.col("quality") & (F.col("kind") != "O"), F.col("kind"))
    rows = rows.withColumns({"seq_no": F.sum(opens.cast("bigint")).over(by), "event": F.last(event, True).over(by)})
    kept = rows.where("kind = 'O' and not quality and event = 'H'")
    parts = F.array_sort(F.collect_list(F.struct("ln", "line")))
    joined = kept.groupBy("file", "seq_no").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "").alias("sequence"))
    return joined.select("file", "seq_no", alphabet.clean(F.col("sequence")).alias("sequence")).where(F.length("sequence") >= k)


def strict_records(rows: DataFrame) -> DataFrame:
    """Sequences of strict four-line FASTQ, of files as lines (file, ln, line): N becomes A, and carriage returns at the ends of lines are dropped.

    A file ends before the first record whose header does not begin with @ or whose sequence has another letter or is
    missing, and after the first whose third line is missing or does not begin with +.
    """
    rows = rows.select("file", F.expr("ln div 4").alias("n"), F.expr("ln % 4").alias("part"), F.rtrim("line", F.lit("\r")).alias("line"))
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("line")))
    found = rows.where("part < 3").groupBy("file", "n").agg(of(0).alias("header"), F.replace(of(1), F.lit("N"), F.lit("A")).alias("sequence"), of(2).alias("plus"))
    before = F.startswith("header", F.lit("@")) & F.col("sequence").isNotNull() & alphabet.is_valid(F.trim("sequence"))
    after = F.startswith("plus", F.lit("+"))
    ends = found.groupBy("file").agg(F.min(F.when(~F.coalesce(before, F.lit(False)), F.col("n"))).alias("bad"), F.min(F.when(~F.coalesce(after, F.lit(False)), F.col("n"))).alias("last"))
    kept = found.join(ends, "file").where((F.col("bad").isNull() | (F.col("n") < F.col("bad"))) & (F.col("last").isNull() | (F.col("n") <= F.col("last"))))
    return kept.select("file", (F.col("n") + 1).cast("bigint").alias("seq_no"), "sequence")
