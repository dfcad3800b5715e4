"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.operators.lineage import release, stored  # noqa: F401

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text (null: empty) and more columns of docs; other columns are left out, so that no name clashes."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *[docs[c] for c in more])


#: A key is hot if it has more than one in HOT of all rows, so that there are fewer than HOT hot keys; parts of its rows.
HOT, PARTS = 1_000, 64


def join_in_parts(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """rows with the columns of keys: an inner join in which the rows of a hot key go to PARTS groups in place of one.

    keys: a stored table of unique keys with n, the number of rows of each; n is not returned.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in keys.where(F.col("n") * HOT > total).select(F.xxhash64(*names)).collect()]  # fewer than HOT
    is_hot = F.xxhash64(*names).isin(hot) if hot else F.lit(False)
    part = F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))).otherwise(0)
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    keys = keys.withColumn("__part", F.explode(parts)).drop("n")
    return rows.withColumn("__part", part.cast("int")).join(keys, [*names, "__part"]).drop("__part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of long ids to (node, component): the smallest id that each node reaches.

    Alternating large-star and small-star rounds; a node's neighbours are never gathered, only their minimum is. Minima
    are stored before they are joined, so that the engine can split the rows of a node with very many neighbours. Lineage
    is cut in the shared folder after every round.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    said = None
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        low2 = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stored(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "links")
        mark = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        same, said = mark == said, mark
        for old in (now, low, large, low2):
            release(old)
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
