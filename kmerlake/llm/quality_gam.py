"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles. Training goes round the features, and in each turn a shallow tree, fitted to
the gradients of the logistic loss, adds a small step to that feature's lookup table; so one table for each feature grows
over many rounds. Then the pairs of features whose joint bins explain most of what is left get two-dimensional tables in
the same way. A score is the logistic function of a sum of looked-up bins, which is computed for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digits", "symbols", "marks", "pipes", "controls",
    "high_bytes", "distinct_words", "same_as_last", "top_word", "log_lines", "line_words", "repeated_lines", "ended_lines",
)
#: Labelled rows that a model is fitted on at most; those with the least hash of doc_id are taken.
SAMPLE = 20_000
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper case, 2 digit, 3 symbol, 4 mark, 5 pipe, 6 control, 7 high byte
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 7
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = 6
_CLASS[list(b"#*$%&<>=_~^\\@{}[]")], _CLASS[list(b"!?")], _CLASS[124] = 3, 4, 5


def features(text: bytes) -> list[float]:
    """FEATURES of a whole text; an empty text has zeros."""
    n = len(text)
    words = text.split()
    if not words:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    share = np.zeros(8)
    for at in range(0, n, 1 << 20):
        share += np.bincount(_CLASS[np.frombuffer(text, np.uint8, min(1 << 20, n - at), at)], minlength=8)
    share /= n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.max()), *share[1:8].tolist(),
        len(seen) / len(words), same / len(words), max(seen.values()) / len(words), float(np.log1p(len(lines))), len(words) / len(lines),
        1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines) / len(lines),
    ]


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton steps of a tree over ordered bins: splits with the largest gain first, a value for each bin."""
    parts = [(0, len(gradient))]
    g, h = np.r_[0, gradient.cumsum()], np.r_[0, weight.cumsum()]
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for part in parts:
            a, b = part
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = score(a, at) + score(at, b) - score(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), part, int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


@dataclass
class Model:
    """edges: inner bounds of each feature's bins; tables and pairs: what a bin, or two bins, add to the logit."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for i, j, t in self.pairs:
            out += t[bins[:, i] // COARSE, bins[:, j] // COARSE]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -30, 30)))


COARSE = 4


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.15, leaves: int = 3, pairs: int = 8, pair_rounds: int = 40, ridge: float = 5.0) -> Model:
    """Model of labels y (0 or 1) by features x. Without rows, or with one class, tables stay zero and the smoothed base rate is the score."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges, float(np.log(rate_1 / (1 - rate_1))), [np.zeros(len(e) + 1) for e in edges], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    at = model.bins(x)
    logit = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(at[:, j], g, len(table)), np.bincount(at[:, j], h, len(table)), leaves, ridge)
            table += step
            logit += step[at[:, j]]
    size = bins // COARSE + 1
    joint = {(i, j): (at[:, i] // COARSE) * size + at[:, j] // COARSE for i, j in combinations(range(len(edges)), 2)}
    g, h = slopes()
    gain = {k: float((np.bincount(c, g, size * size) ** 2 / (np.bincount(c, h, size * size) + ridge)).sum()) for k, c in joint.items()}
    chosen = sorted(gain, key=lambda k: (-gain[k], k))[:pairs]
    grids = {k: np.zeros(size * size) for k in chosen}
    for _ in range(pair_rounds):
        for k in chosen:
            g, h = slopes()
            gs, hs = (np.bincount(joint[k], v, size * size).reshape(size, size) for v in (g, h))
            step = np.zeros((size, size))
            half = shallow_tree(gs.sum(1), hs.sum(1), 2, ridge)  # a first split by rows, then by columns in each half
            for value in np.unique(half):
                rows = half == value
                step[rows] = shallow_tree(gs[rows].sum(0), hs[rows].sum(0), 2, ridge)
            grids[k] += rate * step.ravel()
            logit += rate * step.ravel()[joint[k]]
    model.pairs = [(i, j, grids[i, j].reshape(size, size)) for i, j in chosen]
    return model


def featured(rows: DataFrame, *keep: str) -> DataFrame:
    """The long columns keep, and x: the features of the binary column body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(v) for v in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return rows.select(*keep, "body").mapInArrow(run, ", ".join([*(f"{c} bigint" for c in keep), "x array<double>"]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from labels.quality (0 or 1; other rows are left out) of documents outside the held-out fold.

    sample: labelled rows used at most (by the hash of doc_id), so that what the driver gathers is bounded. A doc_id that is
    labelled several times counts with each label; of documents that share a doc_id the one of the least text hash counts.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality in (0, 1) and labelled is not null and crc32(cast(cast(labelled as string) as binary)) % 5 <> 0")
    known = known.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(sample)
    body = texts(docs).select(F.col("doc_id").cast("bigint").alias("labelled"), F.col("text").cast("binary").alias("body"))
    asked = known.select("labelled").distinct()
    found = featured(body.join(F.broadcast(asked), "labelled").withColumn("order", F.xxhash64("body")), "labelled", "order")
    one = found.groupBy("labelled").agg(F.min(F.struct("order", "x")).alias("least")).select("labelled", "least.x")
    found = one.join(known, "labelled").select("quality", "x").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = found.column("quality").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows come in
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with quality_score (0 to 1) and quality_kept (score >= threshold), in place of columns of these names; null texts count as empty."""
    docs = docs.drop("quality_score", "quality_kept")
    columns = docs.columns
    schema = docs.select(*columns).schema.add("quality_score", "double").add("quality_kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [(v or "").encode() for v in batch.column("text").to_pylist()]
            s = model.scores(np.array([features(v) for v in bodies], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s >= threshold)], [*columns, "quality_score", "quality_kept"])

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (a null doc_id is not held out; repeated rows stay)."""
    model = train(docs, labels, sample)
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False))
    return score(docs.select("doc_id", "text"), model, threshold).select(
        "doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_kept").cast("int").alias("predicted")
    )
