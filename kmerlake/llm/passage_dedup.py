"""Removal of passages of words that start anywhere else, by the suffix array of suffix_dedup over word numbers.

A text becomes one number of WIDTH bytes for each word, so that a passage of `words` words, whatever stands between them, is
a string of `words` * WIDTH bytes, and passages are found as suffix_dedup finds strings. Whole words go, and between what
stays one of the separators around a passage is kept, one with a line feed if there is one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import WORD, release, stored
from .suffix_dedup import bounds, joined, keyed, pieces, repeated_starts, screened

#: Words of a passage: over 50.
WORDS = 51
#: Bytes of a word's number: passages that differ in one word have the same numbers once in 2 ** 40 times.
WIDTH = 5
_WORD = re.compile(WORD.encode())


class Numbers(dict):
    """The number of each word, as WIDTH bytes."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> bytes:
        out = xxhash.xxh3_64_digest(word)[:WIDTH]
        if len(word) <= 64:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = out
        return out


@lru_cache(1)
def known() -> Numbers:
    return Numbers()


def numbers(text: bytes) -> bytes:
    """The numbers of a text's words in a row; words are what ASCII white space separates."""
    return b"".join(map(known().__getitem__, text.split()))


def without_words(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """text without its words begin to end - 1 of each of the ranges, which are in order and do not touch."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for begin, end in gone:
        before = spans[begin - 1][1] if begin else 0
        after = spans[end][0] if end < len(spans) else len(text)
        left, right = text[before : spans[begin][0]], text[spans[end - 1][1] : after]
        out.append(text[done:before])
        if not begin and end == len(spans):
            left = right = b""
        elif not begin:
            right = left
        elif end == len(spans):
            left = right
        out.append(right if b"\n" in right and b"\n" not in left else left)
        done = after
    return b"".join([*out, text[done:]])


def cutter(words: int):
    """A function of (text, ranges of starts in bytes of its numbers, whether the text is there several times): the text without its repeated passages."""

    @F.arrow_udf(StringType())
    def cut(texts: pa.Array, starts: pa.Array, several: pa.Array) -> pa.Array:
        out = []
        for text, ranges, twice in zip(texts, starts, several.to_pylist(), strict=True):
            if not text.is_valid:
                out.append(None)
                continue
            data = bytes(text.as_buffer())
            if twice and len(data.split()) >= words:
                data = b""
            elif ranges.is_valid:
                low, high = joined(*(lambda a, b: (a, b + words * WIDTH - 1))(*bounds(ranges)))
                begin, end = -(-low // WIDTH), (high + 1) // WIDTH
                some = end > begin
                data = without_words(data, list(zip(begin[some].tolist(), end[some].tolist(), strict=True)))
            out.append(data.decode())
        return pa.array(out, pa.string())

    return cut


def without_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs whose texts lack every word of each passage of `words` words that starts anywhere else, in another text or the same.

    Words are what ASCII white space separates; a passage is told by its words alone. Texts of several rows become empty, if
    they have a passage. All else stays byte by byte, but for one of the separators around what goes. Null texts stay null, and
    texts with fewer words stay as they are. Repeated rows hold each other's passages. Columns may have any names.
    """
    rows = keyed(docs)
    classes = stored(rows.groupBy("k1", "k2").agg(F.coalesce(F.min("doc_id"), F.lit(-1)).alias("least"), F.count("*").alias("copies")), "texts")
    texts, read = screened(rows, classes, words * WIDTH, numbers)
    open_parts = stored(pieces(texts, words * WIDTH, numbers, ("doc", "k1", "k2")), "open-parts")
    for old in read:
        release(old)
    found = repeated_starts(open_parts.select("doc", "base", "body"), words * WIDTH)
    starts = open_parts.select("doc", "k1", "k2").distinct().join(found, "doc").select("k1", "k2", "starts")
    what = classes.join(starts, ["k1", "k2"], "left").where("copies > 1 or starts is not null")
    what = stored(what.select(*[F.col(c).alias(f"__{c}") for c in ("k1", "k2", "copies", "starts")]), "passages")
    for old in (classes, open_parts, found):
        release(old)
    names = [f"__{i}" for i in range(len(docs.columns))]  # whatever the columns are called, even alike
    own, text = docs.toDF(*names), names[docs.columns.index("text")]
    own = own.withColumn("__body", F.coalesce(F.col(text), F.lit("")).cast("binary")).withColumns({
        "__a": F.xxhash64("__body"),
        "__b": F.shiftleft(F.hash("__body").cast("bigint"), 32).bitwiseXOR(F.length("__body").cast("bigint")),
    }).drop("__body")
    out = own.join(what, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left")
    there = F.col("__copies").isNotNull()
    cut = cutter(words)(F.when(there, F.col(text)).cast("binary"), F.col("__starts"), F.col("__copies") > 1)
    new = F.when(there, cut).otherwise(F.col(text))
    return out.select(*[(new if n == text else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)])
