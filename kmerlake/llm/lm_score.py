"""Language-model scoring by cross-entropy difference, with exact counts.

A target model (documents that labels call good) and a background model (all documents) share one vocabulary, all words of the
corpus and an unknown one, and one smoothing: bigram counts are interpolated with unigrams, and these with the uniform
distribution. A document is always scored as held-out text: its own counts are taken out of the models that it is part of. Its
score is the mean over its words of the target model's loss less the background model's, in nats: the lower, the nearer to the
target.

Counts are tables that grow with the corpus; no task and not the driver ever holds them all. Documents are put into lots of a
few megabytes. A lot asks for each of its different words and pairs of words once, whatever their number in it: sorted keys,
with the lot's own counts, go to ranges of keys. A range adds the counts that its lots sent and answers each lot in the order of
its keys, so that an answer needs no keys. With the answers of all ranges a lot scores its documents. A gram that is in every
document is one key a lot, and a range holds about RANGE keys at every size.

Keys are 64-bit hashes; the lowest bit tells pairs from words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

#: Bytes of texts in a lot, about, and keys that a range gets, about.
LOT, RANGE = 4 << 20, 1_000_000
#: Trusted ids up to which they are sent to all tasks: 8 bytes each.
FEW = 1_000_000
#: Weight, in observations, of the unigram share in a bigram's probability, and of the uniform share in a unigram's.
KAPPA, ALPHA = 5.0, 1.0
BEGIN = np.uint64(0x9E3779B97F4A7C14)


class Words(dict):
    """The key of each word, as 8 bytes."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> bytes:
        out = (xxhash.xxh3_64_intdigest(word) & ~1).to_bytes(8, "little")
        if len(word) <= 64:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = out
        return out


@lru_cache(1)
def known() -> Words:
    return Words()


def pair_keys(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    x = before * np.uint64(0x9E3779B97F4A7C15) + now
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


class Grams:
    """The words of texts, in lower case, each text after the mark of a beginning.

    keys: different keys in order. word: for each place the index of its key; doc: its text. now: places that are no
    beginning; pair: for each of them the index of the key of the pair that it ends.
    """

    def __init__(self, bodies: list[bytes]):
        get, mark = known().__getitem__, BEGIN.tobytes()
        parts = [mark + b"".join(map(get, x.lower().split())) for x in bodies]
        size = np.array([len(p) // 8 for p in parts], np.int64)
        words = np.frombuffer(b"".join(parts), "<u8")
        self.doc = np.repeat(np.arange(len(size)), size)
        later = np.ones(len(words), bool)
        later[size.cumsum() - size] = False
        self.now, self.n = np.flatnonzero(later), size - 1
        self.keys, where = np.unique(np.concatenate([words, pair_keys(words[self.now - 1], words[self.now])]), return_inverse=True)
        self.word, self.pair = where[: len(words)], where[len(words) :]

    def counts(self, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs, and how often in good texts."""
        every, docs = np.concatenate([self.word, self.pair]), np.concatenate([self.doc, self.doc[self.now]])
        return np.bincount(every, minlength=len(self.keys)), np.bincount(every[good[docs]], minlength=len(self.keys))

    def own(self, where: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How often each key occurs in its own text."""
        _, at, n = np.unique(doc * len(self.keys) + where, return_inverse=True, return_counts=True)
        return n[at]

    def losses(self, counts: list[np.ndarray], parts: list[np.ndarray], totals: list[int], kinds: int) -> list[np.ndarray]:
        """For each model the losses of the texts, sums in nats. parts: whether each text is part of the model."""
        doc = self.doc[self.now]
        word, before, own, own_pair, out = self.word[self.now], self.word[self.now - 1], self.own(self.word, self.doc), self.own(self.pair, doc), []
        for count, part, total in zip(counts, parts, totals, strict=True):
            less = part.astype(np.int64)
            share = (count[word] - less[doc] * own[self.now] + ALPHA) / (total - (less * self.n)[doc] + ALPHA * (kinds + 1))
            loss = -np.log((count[self.pair] - less[doc] * own_pair + KAPPA * share) / (count[before] - less[doc] * own[self.now - 1] + KAPPA))
            out.append(np.bincount(doc, loss, len(self.n)))
        return out


def planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers by bytes, all highest ones first: sorted or small numbers compress well so."""
    data = values.astype(kind)
    return np.ascontiguousarray(data.view(np.uint8).reshape(len(data), -1).T[::-1]).tobytes()


def unplaned(data: memoryview, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n)[::-1].T).view(kind).ravel()


def lots(docs: DataFrame, trusted: DataFrame, size: int = LOT) -> DataFrame:
    """lot, n_bytes, doc_ids, good, texts: documents in lots of some size bytes, good where doc_id is in trusted.

    Up to FEW trusted ids, which are counted, are sent to all tasks; more are joined by a shuffle.
    """
    good = trusted.select(F.col("doc_id").cast("bigint").alias("__good")).where("__good is not null").distinct()
    good = F.broadcast(good) if good.limit(FEW + 1).count() <= FEW else good.hint("merge")
    rows = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(good, F.col("doc_id") == F.col("__good"), "left").select(F.spark_partition_id().alias("task"), "doc_id", F.col("__good").isNotNull().alias("good"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, done = [], 0, 0

        def lot(task: int) -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            kinds = [pa.list_(t) for t in (pa.int64(), pa.bool_(), pa.binary())]
            own = [pa.array([list(c)], t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + done]), pa.array([n], pa.int64()), *own], ["lot", "n_bytes", "doc_ids", "good", "texts"])

        task = 0
        for batch in batches:
            for task, *row in zip(*(batch.column(c).to_pylist() for c in ("task", "doc_id", "good", "text")), strict=True):
                held.append(row)
                n += len(row[2])
                if n >= size:
                    yield lot(task)
                    held, n, done = [], 0, done + 1
        if held:
            yield lot(task)

    return rows.mapInArrow(run, "lot bigint, n_bytes bigint, doc_ids array<bigint>, good array<boolean>, texts array<binary>")


def asked(lot_rows: DataFrame, ranges: int) -> DataFrame:
    """range, lot, n, body: each lot's keys of a range in order, and its own counts of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lot in enumerate(batch.column("lot").to_pylist()):
                grams = Grams(batch.column("texts")[row].as_py())
                both, good = grams.counts(np.array(batch.column("good")[row].as_py(), bool))
                cut = np.flatnonzero(np.r_[True, np.diff(ranges_of(grams.keys, ranges)) > 0])
                out = [(grams.keys[a:b], both[a:b], good[a:b]) for a, b in zip(cut, [*cut[1:], len(grams.keys)], strict=True)]
                at = ranges_of(grams.keys[cut], ranges)
                bodies = [planes(k, "<u8") + planes(c, "<i4") + planes(g, "<i4") for k, c, g in out]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([lot] * len(out), pa.int64()), pa.array([len(k) for k, _, _ in out], pa.int64()), pa.array(bodies, pa.binary())], ["range", "lot", "n", "body"])

    return lot_rows.select("lot", "good", "texts").mapInArrow(run, "range bigint, lot bigint, n bigint, body binary")


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def answered(questions: DataFrame) -> DataFrame:
    """lot, range, n, body: the counts of all lots, in the order of a lot's keys; on a row without a lot the range's different words and their counts."""

    def meet(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        parts = []
        for body, n in zip(table.column("body"), sizes.tolist(), strict=True):
            data = memoryview(body.as_buffer())
            parts.append((unplaned(data, "<u8", n), unplaned(data[8 * n :], "<i4", n), unplaned(data[12 * n :], "<i4", n)))
        keys = np.concatenate([p[0] for p in parts])
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[order][1:] != keys[order][:-1]]
        where = np.empty(len(keys), np.int64)
        where[order] = new.cumsum() - 1
        sums = [np.bincount(where, np.concatenate([p[i] for p in parts])).astype(np.int64) for i in (1, 2)]
        different = keys[order][new]
        words = (different & np.uint64(1) == 0) & (different != BEGIN)
        ends = sizes.cumsum()
        bodies = [planes(sums[0][where[a:b]], "<i8") + planes(sums[1][where[a:b]], "<i8") for a, b in zip(ends - sizes, ends, strict=True)]
        said = [int(words.sum()), *(int(s[words].sum()) for s in sums)]
        many = len(bodies)
        columns = {
            "lot": pa.array([*table.column("lot").to_pylist(), None], pa.int64()), "range": pa.array([table.column("range")[0].as_py()] * (many + 1), pa.int64()),
            "n": pa.array([*sizes.tolist(), 0], pa.int64()), "body": pa.array([*bodies, None], pa.binary()),
        }
        return pa.table(columns | {name: pa.array([None] * many + [x], pa.int64()) for name, x in zip(("words", "background", "target"), said, strict=True)})

    return questions.groupBy("range").applyInArrow(meet, "lot bigint, range bigint, n bigint, body binary, words bigint, background bigint, target bigint")


SCORES = "doc_id bigint, n_words bigint, target_loss double, background_loss double, difference double"


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, lot: int = LOT, size: int = RANGE) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (nats a word), difference of every document under models fitted on all of docs; zeros without words.

    The target are documents with a label quality = 1. Null texts count as empty; repeated rows count and are scored each,
    against one another too; a null doc_id is never in the target. Without a target document the target model is the uniform
    distribution. lot: bytes of text that are scored together; size: keys that a task merges, about. Neither changes a score.
    """
    rows = stored(lots(docs, labels.where("quality = 1"), lot), "lots")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    answers = stored(answered(asked(rows, max(1, -(-total // (6 * size))))), "answers")
    kinds, *totals = answers.where("lot is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "background", "target")]).first()

    def score(documents: pa.Table, found: pa.Table) -> pa.Table:
        if not len(documents):
            return pa.table({c.split()[0]: pa.array([], pa.int64() if "bigint" in c else pa.float64()) for c in SCORES.split(", ")})
        doc_ids, good = documents.column("doc_ids")[0], np.array(documents.column("good")[0].as_py(), bool)
        grams = Grams(documents.column("texts")[0].as_py())
        found = found.sort_by("range")
        bodies = [(memoryview(x.as_buffer()), n) for x, n in zip(found.column("body"), found.column("n").to_pylist(), strict=True)]
        counts = [np.concatenate([unplaned(data[8 * i * n :], "<i8", n) for data, n in bodies]) for i in (0, 1)]
        losses = grams.losses(counts, [np.ones(len(good), bool), good], totals, kinds)
        background, target = (x / np.maximum(grams.n, 1) for x in losses)
        return pa.table({"doc_id": pa.array(doc_ids.as_py(), pa.int64()), "n_words": grams.n, "target_loss": target, "background_loss": background, "difference": target - background})

    documents = rows.select("lot", "doc_ids", "good", "texts")
    return documents.groupBy("lot").cogroup(answers.where("lot is not null").select(F.col("lot").alias("asker"), "range", "n", "body").groupBy("asker")).applyInArrow(score, SCORES)
