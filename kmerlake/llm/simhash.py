"""SimHash near-duplicates: 64-bit fingerprints linked by a self-join of their binary trie.

The trie of the distinct fingerprints is a sorted array of which each node is a range. The self-join goes down from pairs
of nodes, adds up the bits in which the two sides differ, and drops a pair as soon as these exceed the budget. Fingerprints
within a budget of k bits agree wholly in one of k + 1 blocks of their bits. So the trie is joined once for each block, with
the fingerprints turned so that the block's bits come first: there the join goes down the block's levels with no bit spent,
which is a grouping by the block, and walks pairs of nodes from these levels on. Every fingerprint is sent k + 1 times,
however many there are; many small subtries share a task. Subtries with too many fingerprints for a task go down further
levels in the engine, pair by pair, as often as it takes. A task walks its subtries level by level, all node pairs of a
level at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, stored, texts

SEED, SHINGLE, BUDGET = 42, 3, 2
#: Distinct fingerprints that a task should walk at a time; those that a subtrie, or a pair of them, may hold; levels by which a larger one goes down.
NODE, MOST, STEP = 20_000, 200_000, 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Words between ASCII white space, A-Z in lower case, shingles joined by a space; 0 for a text without a word."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash64(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1]
        hashes = [hash64(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    values = np.array(hashes, ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 8192):
        ones += np.unpackbits(values[at : at + 8192].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document's whole text, and more long columns of docs; null is empty, with fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x) for x in batch.column("text").to_pylist()]
            columns = batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), *(batch.column(c) for c in more)
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "fp", *more])

    rows = texts(docs, *more).select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"), *more)
    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("doc_id", "fp", *more)))


def trie_pairs(left: np.ndarray, right: np.ndarray, nodes: np.ndarray, level: int, budget: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted fingerprints in left and right, under the given pairs of nodes, that differ in at most budget bits.

    nodes: rows (low, high, low, high, bits in which they differ so far) of ranges in left and right that agree in their
    first `level` bits each. Frontiers of over `most` node pairs are walked in parts, so that memory stays bounded.
    """
    stack = [(level, nodes[at : at + most]) for at in range(0, len(nodes), most)]
    while stack:
        level, nodes = stack.pop()
        nodes = nodes[nodes[:, 4] <= budget]
        small = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= 4
        if level == 64:
            small[:] = True
        for i in range(2):  # small nodes: compare the leaves below
            for j in range(4):
                for a, b in ((i, j), (j, i)) if i != j else ((i, j),):
                    if a > 3 or b > 3:
                        continue
                    x = nodes[small]
                    x = x[(x[:, 0] + a < x[:, 1]) & (x[:, 2] + b < x[:, 3])]
                    p, q = x[:, 0] + a, x[:, 2] + b
                    ok = np.bitwise_count(left[p] ^ right[q]) <= budget
                    if ok.any():
                        yield p[ok], q[ok]
        nodes = nodes[~small]
        if not len(nodes):
            continue
        bit = np.uint64(1) << np.uint64(63 - level)
        mid_l, mid_r = (middle(side, nodes[:, a], nodes[:, a + 1], level, bit) for side, a in ((left, 0), (right, 2)))
        l0, l1, r0, r1, err = nodes.T
        below = np.concatenate([
            np.stack([a, b, c, d, err + e], 1)
            for (a, b), (c, d), e in (((l0, mid_l), (r0, mid_r), 0), ((mid_l, l1), (mid_r, r1), 0), ((l0, mid_l), (mid_r, r1), 1), ((mid_l, l1), (r0, mid_r), 1))
        ])
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        for at in range(0, len(below), most):
            stack.append((level + 1, below[at : at + most]))


def middle(side: np.ndarray, low: np.ndarray, high: np.ndarray, level: int, bit: np.uint64) -> np.ndarray:
    """Where the fingerprints of each node, a range of side that agrees in the bits above, turn from bit 0 to bit 1."""
    above = ~((bit << np.uint64(1)) - np.uint64(1)) if level else np.uint64(0)
    border = (side[low] & above) | bit
    return np.clip(np.searchsorted(side, border), low, high)


class Forest:
    """Union-find over indices; only the links that joined two trees are kept, at most one fewer than the nodes."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def node_pairs(rows: DataFrame, depth: int, step: int, budget: int) -> DataFrame:
    """id, fp, a, b: rows of the node pairs (a, b) at depth, sent to the pairs below them, step levels down, within the budget.

    a and b are prefixes of depth bits, and each row has one of them. It goes to every pair of its own prefix with one
    below the other that differs in few enough bits; both sides of a pair name it by its lesser and its greater prefix.
    """
    flips = [sum(1 << x for x in bits) for k in range(budget + 1) for bits in combinations(range(step), k)]
    above = F.shiftrightunsigned("fp", 64 - depth).bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b")) if depth else F.lit(0).cast("long")
    rows = rows.select("id", "fp", "a", "b", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip"))
    rows = rows.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) + F.bit_count("flip") <= budget)
    own = F.shiftrightunsigned("fp", 64 - depth - step)
    other = F.shiftleft(above, step).bitwiseOR(own.bitwiseAND(F.lit((1 << step) - 1).cast("long")).bitwiseXOR(F.col("flip")))
    return rows.select("id", "fp", own.alias("own"), other.alias("other")).select("id", "fp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def turned(fp: Column, by: int) -> Column:
    """fp with its first `by` bits moved to its end."""
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def spanning(ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """(a, b): a spanning forest, not all pairs, of the links between ids."""
    forest = Forest(len(ids))
    for p, q in pairs:
        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            if i != j:
                forest.join(i, j)
    roots = np.array([forest.root(i) for i in range(len(ids))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[roots[moved]], pa.int64())})


def links(nodes: DataFrame, budget: int = BUDGET, node: int = NODE, most: int = MOST) -> DataFrame:
    """(a, b): links between node ids that join exactly the nodes which fingerprints within the budget join.

    nodes: id (long, unique), fp (long, unique). Subtries of up to `most` fingerprints are dealt to groups of about `node`;
    larger ones, as many near copies of one text may make, are split STEP levels further until none is left. A task returns
    a spanning forest, not all pairs.
    """
    groups = max(1, nodes.count() // node)
    found = None
    for block in range(budget + 1):
        begin, end = (64 * i // (budget + 1) for i in (block, block + 1))
        for part in links_by_block(nodes.select("id", turned(F.col("fp"), begin).alias("fp")), end - begin, budget, groups, most):
            found = part if found is None else found.union(part)
    return found


def links_by_block(rows: DataFrame, depth: int, budget: int, groups: int, most: int) -> list[DataFrame]:
    """Links of fingerprints whose first depth bits agree."""
    prefix = F.shiftrightunsigned("fp", 64 - depth)
    large = stored(rows.groupBy(prefix.alias("a")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("a"), "large")

    def walk(table: pa.Table) -> pa.Table:
        """All subtries of a group, each against itself."""
        ids, fps = table.column("id").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(fps, kind="stable")
        ids, fps = ids[order], fps[order]
        above = fps >> np.uint64(64 - depth)
        low = np.flatnonzero(np.r_[True, above[1:] != above[:-1]])
        high = np.r_[low[1:], len(fps)]
        low, high = low[high - low > 1], high[high - low > 1]
        return spanning(ids, trie_pairs(fps, fps, np.stack([low, high, low, high, np.zeros_like(low)], 1), depth, budget))

    def walk_pair(table: pa.Table) -> pa.Table:
        """The subtries of two prefixes against each other."""
        ids, fps = table.column("id").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        level = table.column("depth")[0].as_py()
        low, high = (np.array([table.column(c)[0].as_py()], np.int64).view(np.uint64)[0] for c in ("a", "b"))
        order = np.argsort(fps, kind="stable")
        ids, fps = ids[order], fps[order]
        above = fps >> np.uint64(64 - level)
        a, b = np.flatnonzero(above == low), np.flatnonzero(above == high)
        if not len(a) or not len(b):
            return spanning(ids[:0], iter(()))
        start = np.array([[0, len(a), 0, len(b), int(low ^ high).bit_count()]])
        return spanning(ids, ((a[p], b[q]) for p, q in trie_pairs(fps[a], fps[b], start, level, budget)))

    if large.isEmpty():
        kept, split = rows, False
    else:
        kept, split = rows.join(large, prefix == F.col("a"), "left_anti"), True
    parts = [kept.groupBy(F.pmod(F.xxhash64(prefix), F.lit(groups)).alias("group")).applyInArrow(lambda t: walk(t.select(["id", "fp"])), "a bigint, b bigint")]
    level = rows.join(large.select(F.col("a").alias("p")), prefix == F.col("p")).select("id", "fp", prefix.alias("a"), prefix.alias("b")) if split else None
    while split:
        step = min(STEP, 64 - depth)
        level = stored(node_pairs(level, depth, step, budget), "pairs-below")
        depth += step
        large = stored(level.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > most).select("a", "b"), "large") if depth < 64 else None
        split = large is not None and not large.isEmpty()
        tagged = level.withColumn("depth", F.lit(depth))
        small = tagged.join(large, ["a", "b"], "left_anti").select(tagged.columns) if split else tagged
        parts.append(small.groupBy("depth", "a", "b").applyInArrow(walk_pair, "a bigint, b bigint"))
        level = level.join(large, ["a", "b"], "left_semi").select("id", "fp", "a", "b") if split else None
    return parts


def components(rows: DataFrame, key: str | Column, budget: int) -> DataFrame:
    """fp, least (key), component (the smallest fingerprint reached by links within the budget) of the distinct fingerprints of rows."""
    classes = stored(rows.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    joined = stored(links(classes.select(F.col("fp").alias("id"), "fp"), budget), "pairs")
    reach = connected(joined)
    return classes.join(reach, classes["fp"] == reach["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reached by links within the budget).

    Empty texts share fingerprint 0. Repeated rows stay. Rows with a null doc_id take part under their fingerprint; a
    component of such rows only has a null component_id. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    known = components(rows, "doc_id", budget)
    lowest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(known.join(lowest, "component").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest doc_id stays, once.

    Nulls come after all doc_ids, so that a component whose doc_ids are all null keeps one row as well. A row is known by
    its doc_id and 128 bits of hash of its text: different texts with one doc_id stay if their components differ.
    """
    hashes = {"__h": F.xxhash64("text"), "__g": F.xxhash64(F.lit(1), "text")}
    rows = stored(fingerprints(docs.withColumns(hashes), *hashes), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("__doc"), "__h", "__g")
    keep = components(rows, key, budget).groupBy("component").agg(F.min("least").alias("least")).select("least.*")
    names = ["__null", "__doc", *hashes]
    marked = docs.withColumns({"__null": F.col("doc_id").cast("bigint").isNull(), "__doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), **hashes})
    return marked.join(keep, names, "left_semi").dropDuplicates(names).select(*docs.columns)
