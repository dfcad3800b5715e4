"""Quality rules: structural counts, and a log-likelihood ratio of hashed n-grams. DataFrame functions only.

Words and pairs of neighbouring words fall into BUCKETS cells by hash. Two multinomials over the cells are counted over all
documents: trusted ones (the target) and all (the raw corpus). A document's ratio is the mean over its n-grams of
log(target share / raw share) of their cells. Cell weights are whole numbers of 1 / SCALE nats, so that sums are exact and
do not depend on the order of addition. Verdicts follow by one threshold for all documents: the lower fence of the ratios of
the trusted documents, which comes from their quartiles and so from the corpus at hand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

BUCKETS = 1 << 14
SCALE = 1_000
#: Added to every cell of both multinomials.
SMOOTHING = 1.0
#: Documents whose ratio lies more than so many interquartile ranges below the trusted documents' first quartile are dropped.
FENCE = 3.0
BLANK = " \t\n\u000b\f\r"
#: Words up to which a window's place fits beside its hash in one long.
PLACE_BITS = 21


def words_of(text: Column) -> Column:
    """Words of a text between ASCII white space."""
    inner = F.btrim(text, F.lit(BLANK))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def head(a: str, less: int = 1) -> Column:
    """The array a without its last elements."""
    return F.slice(F.col(a), F.lit(1), F.greatest(F.lit(0), F.size(a) - less))


def tail(a: str, less: int = 1) -> Column:
    """The array a without its first elements."""
    return F.slice(F.col(a), F.lit(1 + less), F.greatest(F.lit(0), F.size(a) - less))


def hashed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, words, u (a hash of each word), b (of each two neighbours), and more columns."""
    rows = texts(docs, *more).withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("u", F.transform("words", lambda w: F.xxhash64(w)))
    return rows.withColumn("b", F.zip_with(head("u"), tail("u"), lambda x, y: F.xxhash64(x, y)))


def cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def cell_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """cell, raw, target: n-grams of all documents, and of those whose doc_id is in trusted, by cell.

    Trusted ids may be as many as documents, so the join is by a shuffle of both, the same at every size.
    """
    good = trusted.select(F.col("doc_id").alias("__good")).where("__good is not null").distinct()
    flagged = docs.select("doc_id", "text").join(good.hint("merge"), F.col("doc_id") == F.col("__good"), "left").withColumn("__t", F.col("__good").isNotNull().cast("int"))
    grams = hashed(flagged, "__t").select("__t", F.explode(F.concat("u", "b")).alias("h"))
    return grams.groupBy(cell(F.col("h")).alias("cell")).agg(F.count("*").alias("raw"), F.sum("__t").alias("target"))


def cell_weights(counts: DataFrame) -> list[int]:
    """Weight of each cell in 1 / SCALE nats; zeros if nothing is trusted. At most BUCKETS rows reach the driver."""
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():
        raw[r["cell"]], target[r["cell"]] = r["raw"], r["target"]
    if not sum(target):
        return [0] * BUCKETS
    shift = math.log(sum(raw) + SMOOTHING * BUCKETS) - math.log(sum(target) + SMOOTHING * BUCKETS)
    return [round(SCALE * (math.log(t + SMOOTHING) - math.log(r + SMOOTHING) + shift)) for r, t in zip(raw, target, strict=True)]


def repeat_words(rows: DataFrame) -> DataFrame:
    """rows of hashed(), with n_repeat_words: words in 3-word windows that are found twice or more in the text.

    The hash of a window, without its last bits, and its place share a long, so that one sort of longs brings equal windows
    together; the full hashes of neighbours decide. Texts in which neighbours agree in the bits kept but not in the others,
    so that they may part equal windows, and texts of 2 ** PLACE_BITS words or more, sort pairs of hash and place instead.
    """
    mask = (1 << PLACE_BITS) - 1
    few = F.size("words") < (1 << PLACE_BITS)
    rows = rows.withColumn("w3", F.zip_with(head("b"), tail("u", 2), lambda x, y: F.xxhash64(x, y)))
    rows = rows.withColumn("s", F.when(few, F.sort_array(F.transform("w3", lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))))))
    at = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    alike = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0
    near = F.zip_with(head("s"), tail("s"), lambda x, y: F.when(alike(x, y), F.struct(at(x).alias("x"), at(y).alias("y"), (F.get("w3", at(x)) == F.get("w3", at(y))).alias("same"))))
    rows = rows.withColumn("near", F.filter(near, lambda p: p.isNotNull()))
    sure = few & ~F.exists("near", lambda p: ~p["same"])
    pairs = F.array_sort(F.transform("w3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("long", F.when(~sure, pairs))
    twins = F.filter(F.zip_with(head("long"), tail("long"), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())
    places = F.when(sure, F.concat(F.transform("near", lambda p: p["x"]), F.transform("near", lambda p: p["y"]))).otherwise(F.flatten(twins))
    rows = rows.withColumn("at", F.sort_array(F.array_distinct(places)))
    reach = F.aggregate(F.zip_with(head("at"), tail("at"), lambda x, y: F.least(y - x, F.lit(3))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.when(F.size("at") > 0, reach + 3).otherwise(F.lit(0)).cast("bigint")).drop("w3", "s", "near", "long", "at")


def measured(docs: DataFrame, weights: list[int]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr of every document."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, h: s + F.get(table, cell(h)))
    rows = repeat_words(hashed(docs))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        ((total("u") + total("b")) / SCALE).alias("nats"),
        (F.size("u") + F.size("b")).alias("grams"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    llr = F.when(F.col("grams") > 0, F.col("nats") / F.col("grams")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), llr.alias("llr"))


def least_ratio(rows: DataFrame, trusted: DataFrame, fence: float = FENCE) -> float:
    """The lower fence of the ratios of trusted documents in rows of measured(), without those that fail the base rules.

    Quartiles are exact to 1 / SCALE nats: ratios are counted by their whole thousandths, of which there are some ten
    thousands at most, and only these counts reach the driver. Without a trusted document there is no lower bound.
    """
    good = trusted.select(F.col("doc_id").alias("__good")).where("__good is not null").distinct()
    known = rows.where(~F.col("base_failed")).select("doc_id", F.floor(F.col("llr") * SCALE).alias("level"))
    known = known.join(good.hint("merge"), F.col("doc_id") == F.col("__good"), "left_semi")
    levels = sorted((r["level"], r["n"]) for r in known.groupBy("level").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in levels)
    if not total:
        return -math.inf
    quartiles, seen = {}, 0
    for level, n in levels:
        seen += n
        for q in (1, 3):
            if 4 * seen >= q * total:
                quartiles.setdefault(q, level)
    return (quartiles[1] - fence * (quartiles[3] - quartiles[1])) / SCALE


def quality_rules(docs: DataFrame, labels: DataFrame, fence: float = FENCE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr of every document.

    Weights are counted over all of docs; trusted are documents with a label quality = 1; kept are documents that pass the
    base rules and whose ratio reaches least_ratio(). A null text has no words. Repeated rows are counted and judged each.
    Without trusted documents all ratios are 0 and the base rules alone decide. A null doc_id is never trusted. An empty
    table gives no rows.
    """
    trusted = labels.where("quality = 1").select("doc_id")
    rows = stored(measured(docs, cell_weights(cell_counts(docs, trusted))), "measured")
    kept = ~F.col("base_failed") & (F.col("llr") >= least_ratio(rows, trusted, fence))
    return rows.select(*rows.columns[:-1], kept.alias("kept"), "llr")
