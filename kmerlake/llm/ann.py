"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits a bounded sample of vectors by hyperplanes halfway between two of them, at the median, down to small
leaves; every vector of the table is then sent down every tree. A query goes down all trees at once: one priority queue,
shared by the trees, holds the branches not taken, least distance to a splitting plane first, until `leaves` leaves are
found; how many it takes is measured on calibration queries, whose neighbours among all rows are known by brute force. The vectors in these leaves are candidates, whose exact distances decide. Equal vectors are one entry with several
ids, so that no leaf is filled by copies of one vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors that the trees are fitted on at most; trees; vectors in a leaf of the whole table, about; leaves searched at least.
SAMPLE, TREES, LEAF, LEAVES = 20_000, 10, 256, 240
#: Calibration queries, and the share of their k nearest that the leaves searched must hold: 0.9 and a margin for other queries.
CALIBRATION, RECALL = 64, 0.95
#: Visits of leaves listed at once.
VISITS = 200_000


@dataclass
class Tree:
    """Inner node i splits by planes[i] at bounds[i]; children are inner nodes, or leaves as -1 - leaf."""

    planes: np.ndarray
    bounds: np.ndarray
    children: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if len(self.planes) else np.full(len(x), -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            side = np.einsum("ij,ij->i", x[inner], self.planes[at]) > self.bounds[at]
            node[inner] = self.children[at, side.astype(np.int64)]
        return -1 - node


def grow(sample: np.ndarray, leaf: int, random: np.random.Generator) -> Tree:
    planes, bounds, children = [], [], []
    todo = [(np.arange(len(sample)), None)]
    leaves = 0
    while todo:
        rows, above = todo.pop()
        split = None
        if len(rows) > leaf:
            for _ in range(4):
                a, b = sample[random.choice(rows, 2, replace=False)]
                plane = a - b
                if not (norm := np.linalg.norm(plane)):
                    continue
                side = sample[rows] @ (plane / norm)
                bound = float(np.median(side))
                right = side > bound
                if 0 < right.sum() < len(rows):
                    split = plane / norm, bound, right
                    break
        if split is None:
            node, leaves = -1 - leaves, leaves + 1
        else:
            node = len(planes)
            planes.append(split[0])
            bounds.append(split[1])
            children.append([0, 0])
            todo += [(rows[split[2]], (node, 1)), (rows[~split[2]], (node, 0))]
        if above:
            children[above[0]][above[1]] = node
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(np.array(planes).reshape(-1, width), np.array(bounds), np.array(children, np.int64).reshape(-1, 2))


def search(trees: list[Tree], q: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the leaves found for q through one queue over all trees, nearest branches first."""
    queue = [(0.0, t, 0 if len(tree.planes) else -1) for t, tree in enumerate(trees)]
    margins = [np.abs(m) for m in (tree.planes @ q - tree.bounds if len(tree.planes) else np.zeros(0) for tree in trees)]
    signs = [(tree.planes @ q > tree.bounds) if len(tree.planes) else np.zeros(0, bool) for tree in trees]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < leaves:
        far, t, node = heapq.heappop(queue)
        while node >= 0:
            side = int(signs[t][node])
            heapq.heappush(queue, (max(far, float(margins[t][node])), t, int(trees[t].children[node, 1 - side])))
            node = int(trees[t].children[node, side])
        found.append((t, -1 - node))
    return found


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def leaves_for(entries: DataFrame, forest: list[Tree], k: int, recall: float = RECALL, queries: int = CALIBRATION) -> int:
    """Leaves to search so that of the k nearest entries to each calibration query a share of at least recall is found.

    Calibration queries are the entries of the least h2. Every task compares its rows with all of them, batch by batch, and
    returns its k + 1 nearest to each. A neighbour is found with the first of its leaves, one in each tree, that the
    query's search comes to, so that the recall of any number of leaves follows from one search through all of them.
    """
    asked = entries.orderBy("h2", "h1").limit(queries).select("entry", "v").toArrow().combine_chunks()
    if not len(asked):
        return 1
    x, own = matrix(asked.column("v").combine_chunks()), asked.column("entry").to_pylist()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not len(batch):
                continue
            y = matrix(batch.column("v"))
            d = (y * y).sum(1) - 2 * x @ y.T
            near = np.argpartition(d, min(k, len(y) - 1), axis=1)[:, : k + 1]
            found = pa.table({
                "query": np.repeat(np.arange(len(x)), near.shape[1]), "entry": batch.column("entry").take(pa.array(near.ravel())),
                "v": batch.column("v").take(pa.array(near.ravel())), "far": np.take_along_axis(d, near, 1).ravel(),
            })
            best = (found if best is None else pa.concat_tables([best, found])).sort_by([("query", "ascending"), ("far", "ascending")])
            group = best.column("query").to_numpy()
            best = best.filter(pa.array(np.arange(len(group)) - np.searchsorted(group, group) <= k))
        if best is not None:
            yield from best.select(["query", "entry", "v", "far"]).combine_chunks().to_batches()

    kind = entries.schema["v"].dataType.simpleString()
    found = entries.select("entry", "v").mapInArrow(nearest, f"query bigint, entry bigint, v {kind}, far double")
    by = Window.partitionBy("query").orderBy("far", "entry")
    found = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).orderBy("query", "far", "entry").toArrow().combine_chunks()
    query, entry = found.column("query").to_numpy(), found.column("entry").to_pylist()
    at = np.stack([tree.leaf_of(matrix(found.column("v").combine_chunks())) for tree in forest], 1)
    places = []
    for i in range(len(x)):
        order = {leaf: n for n, leaf in enumerate(search(forest, x[i], sum(len(t.planes) + 1 for t in forest)), 1)}
        rows = [j for j in np.flatnonzero(query == i) if entry[j] != own[i]][:k]
        places += [min(order[t, leaf] for t, leaf in enumerate(at[j].tolist())) for j in rows]
    return sorted(places)[int(np.ceil(recall * len(places))) - 1] if places else 1


def neighbours(table: DataFrame, every: int = 100, k: int = 10, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, leaves: int | None = None, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by Euclidean distance, of each row whose vec_id is divisible by `every`.

    Vectors that are null, empty, zero or not wholly finite, or whose length is not the most common one, and rows without
    vec_id take no part. Rows with equal vec_id and vector count once. Queries have fewer rows only if there are fewer
    candidates in the leaves searched; an empty table gives no rows. leaves: None for as many as leaves_for() says, LEAVES at least.
    """
    kind = "float" if dict(table.dtypes).get("embedding") == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = table.select(F.col("vec_id").cast("bigint"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == width["n"]).withColumn("v", F.transform("v", lambda x: (x + F.lit(0).cast(kind)).cast(kind))).withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    # of equal vectors only the k + 1 least ids can be among the k nearest to anything
    first = Window.partitionBy("h1", "h2", "v").orderBy("vec_id")
    least = rows.select("vec_id", "h1", "h2", "v").withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)
    entries = stored(least.groupBy("h1", "h2", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("entry"), "h1", "h2", "v", "ids"), "entries")
    count = entries.count()
    pool = entries.orderBy("h1", "h2").limit(sample).select("v").toArrow().column("v").to_pylist()
    random = np.random.default_rng(seed)
    pool = np.array(pool, float).reshape(len(pool), -1)
    small = max(4, leaf * len(pool) // max(count, 1))
    forest = [grow(pool, small, random) for _ in range(trees)]
    if leaves is None:
        leaves = max(LEAVES, leaves_for(entries, forest, k))
    shared = table.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            for t, tree in enumerate(shared.value):
                at = tree.leaf_of(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(at.astype(np.int32)), batch.column("entry"), batch.column("v")], ["tree", "leaf", "entry", "v"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, VISITS // leaves)
        for batch in (part.slice(begin, step) for part in batches for begin in range(0, len(part), step)):
            x = matrix(batch.column("v"))
            found = [(i, t, at) for i, y in enumerate(x) for t, at in search(shared.value, y, leaves)]
            rows, tree, at = (pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32())))
            yield pa.RecordBatch.from_arrays([tree, at, batch.column("query").take(rows), batch.column("v").take(rows)], ["tree", "leaf", "query", "v"])

    def rerank(key, kept: pa.Table, asked: pa.Table) -> pa.Table:
        """Of the entries of a leaf, those among the k + 1 nearest, or as near as the last of them, to each query that visits it."""
        queries, at, scores = [], [], []
        if len(kept) and len(asked):
            x, y = (matrix(t.column("v").combine_chunks()) for t in (kept, asked))
            for i in range(len(y)):
                gap = x - y[i]
                d = np.sqrt((gap * gap).sum(1))
                near = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                queries.append(np.full(len(near), i))
                at.append(near)
                scores.append(d[near])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({
            "query": asked.column("query").take(pa.array(join(queries, np.int64))), "entry": kept.column("entry").take(pa.array(join(at, np.int64))),
            "score": pa.array(join(scores, np.float64)),
        })

    asked = rows.where(F.col("vec_id") % every == 0)
    asked = stored(asked.select("vec_id", "h1", "h2", "v").join(entries.select("h1", "h2", F.col("v").alias("w"), "entry"), ["h1", "h2"]).where("v = w").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query"), "v").dropDuplicates(["query_id", "query"]), "queries")
    queries = asked.dropDuplicates(["query"]).select("query", "v")
    placed = entries.select("entry", "v").mapInArrow(place, f"tree int, leaf int, entry bigint, v array<{kind}>")
    visits = queries.mapInArrow(look, f"tree int, leaf int, query bigint, v array<{kind}>")
    scored = placed.groupBy("tree", "leaf").cogroup(visits.groupBy("tree", "leaf")).applyInArrow(rerank, "query bigint, entry bigint, score double")
    scored = scored.distinct()
    # k + 1 entries at most can matter: each holds an id, and one of them may be the query itself
    near = Window.partitionBy("query").orderBy("score")
    near = scored.withColumn("r", F.rank().over(near)).where(F.col("r") <= k + 1).select("query", "entry", "score")
    ids = near.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    by = Window.partitionBy("query").orderBy("score", "vec_id")
    ids = stored(ids.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).select("query", "score", "vec_id"), "nearest")
    out = asked.select("query_id", "query").join(ids, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
