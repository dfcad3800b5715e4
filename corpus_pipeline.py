"""A corpus pipeline: classify, dedup lines, drop near-duplicates, drop repeated passages, pack.

Each stage is a function of (spark, docs, sf_dir); run() writes what it returns as Parquet and gives the next stage the
table read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerlake.llm import line_dedup, packing, passage_dedup, quality_gam, simhash
from kmerlake.llm.common import stored, table
from kmerlake.llm.queries import vocabulary_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents' labels, accepts."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.score(docs, model).where("quality_kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; no document goes."""
    return line_dedup.without_repeated_lines(docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) n_chars")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def dedup_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages of over 50 words that start anywhere else; no document goes."""
    return passage_dedup.without_passages(docs.select(*COLUMNS)).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs, vocabulary_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("suffix-array dedup", dedup_strings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs


#: Models and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
