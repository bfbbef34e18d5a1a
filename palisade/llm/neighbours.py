"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample (SAMPLE vectors, chosen by hash); every vector is then indexed: it falls to one leaf
of each tree. A query walks all trees at once through one shared priority queue, nearest split margins first, until the
leaves it has met hold its budget of rows. All rows of these leaves are candidates, ranked by exact distance in double
precision. Leaves are dealt in blocks of rows, so a crowded leaf is no single task's.

The budget is measured, not guessed: for PROBES queries the true neighbours are found by brute force over all rows, and
the budget is the number of rows a query must look at to meet the leaf of a share TARGET of these neighbours.

Equal vectors are indexed once with their least ids, as many as a result can show. The forest is bounded by SAMPLE and
the count of trees, and so is the table of leaf sizes; both are sent to the tasks.

Defined cases: null ids and vectors, zero vectors and those with null or non-finite components take no part; of rows
that share an id the least vector counts; vectors are compared with those of their own length only; ties go to the
smaller id; fewer candidates give fewer ranks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialize

SAMPLE, TREES, LEAF = 20_000, 16, 64
#: Queries that measure the budget, the recall it is to reach, and rows of a leaf in one task.
PROBES, TARGET, ROWS = 64, 0.96, 4096
SEED = 11


@dataclass
class Tree:
    """Inner node k sends x left if normal[k] @ x < cut[k]; children below zero are leaves, -1 - number."""

    normal: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.cut) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            k = at[inner]
            side = np.einsum("ij,ij->i", self.normal[k], x[inner]) < self.cut[k]
            at[inner] = np.where(side, self.left[k], self.right[k])
        return -1 - at


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Splits at the median of the projection on the line through two random points, down to leaves of a size."""
    normal, cut, left, right = [], [], [], []
    leaves = 0
    todo: list[tuple[np.ndarray, int, bool]] = [(np.arange(len(x)), -1, True)]
    while todo:
        rows, parent, is_left = todo.pop()
        made = None
        if len(rows) > leaf:
            for _ in range(4):
                a, b = x[rng.choice(rows, 2, replace=False)]
                line = a - b
                if norm := float(np.linalg.norm(line)):
                    line = line / norm
                    at = x[rows] @ line
                    middle = float(np.median(at))
                    side = at < middle
                    if 0 < side.sum() < len(rows):
                        made = len(cut)
                        normal.append(line)
                        cut.append(middle)
                        left.append(0)
                        right.append(0)
                        todo += [(rows[~side], made, False), (rows[side], made, True)]
                        break
        if made is None:
            made = -1 - leaves
            leaves += 1
        if parent >= 0:
            (left if is_left else right)[parent] = made
    return Tree(np.array(normal).reshape(len(cut), x.shape[1]).astype(np.float32), np.array(cut, np.float32), np.array(left, np.int64), np.array(right, np.int64))


def search(trees: list[Tree], sizes: dict[tuple[int, int], int], q: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) met by the shared queue until they hold the budget."""
    sides = [t.normal @ q - t.cut if len(t.cut) else np.zeros(0) for t in trees]
    queue = [(-np.inf, k, 0 if len(t.cut) else -1) for k, t in enumerate(trees)]
    heapq.heapify(queue)
    met, held = [], 0
    while queue and held < budget:
        worst, k, node = heapq.heappop(queue)
        if node < 0:
            if n := sizes.get((k, -1 - node), 0):
                met.append((k, -1 - node))
                held += n
            continue
        margin = float(sides[k][node])
        near, far = (trees[k].left[node], trees[k].right[node]) if margin < 0 else (trees[k].right[node], trees[k].left[node])
        heapq.heappush(queue, (worst, k, int(near)))
        heapq.heappush(queue, (max(worst, abs(margin)), k, int(far)))
    return met


def needed_budget(trees: list[Tree], sizes: dict[tuple[int, int], int], q: np.ndarray, neighbours: np.ndarray) -> list[int]:
    """For each neighbour, the rows that the search holds once it has met a leaf with it."""
    order = search(trees, sizes, q, 1 << 62)
    held = dict(zip(order, np.cumsum([sizes[leaf] for leaf in order]).tolist(), strict=True))
    leaves = np.stack([t.leaves(neighbours) for t in trees], 1)
    return [min(held.get((k, int(f)), 1 << 62) for k, f in enumerate(row)) for row in leaves]


def exact(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """query_id, vec_id, score, embedding: the k nearest of each of a few queries by brute force over rows."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths = b["embedding"].map(len).to_numpy()
            for q, e in queries:
                part = b[(lengths == len(e)) & (b["vec_id"] != q).to_numpy()]
                if len(part):
                    d = np.sqrt(((np.stack(part["embedding"]) - e) ** 2).sum(1))
                    best = np.lexsort((part["vec_id"], d))[:k]
                    yield part.iloc[best].assign(query_id=q, score=d[best])[["query_id", "vec_id", "score", "embedding"]]

    found = rows.mapInPandas(scan, "query_id long, vec_id long, score double, embedding array<double>")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding array<double>: the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, probes: int = PROBES, target: float = TARGET, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by Euclidean distance."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(usable(vectors))
    least = Window.partitionBy("embedding").orderBy("vec_id")
    # k + 1 ids of a vector: one of them may be the query's own
    distinct = rows.withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= k + 1)
    distinct = materialize(distinct.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))

    picked = distinct.orderBy(F.xxhash64(F.lit(seed), F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("embedding").toPandas()["embedding"]
    by_length: dict[int, list[np.ndarray]] = {}
    for e in picked:
        by_length.setdefault(len(e), []).append(np.asarray(e, np.float64))
    forest = {n: [grow(np.stack(x), leaf, np.random.default_rng([seed, n, t])) for t in range(trees)] for n, x in by_length.items()}
    sent = spark.sparkContext.broadcast(forest)

    def trees_for(n: int) -> list[Tree]:
        return sent.value.get(n) or [Tree(np.zeros((0, n), np.float32), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def fall(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths = b["embedding"].map(len)
            for n, part in b.groupby(lengths):
                x = np.stack(part["embedding"]).astype(np.float32)
                for t, tree in enumerate(trees_for(int(n))):
                    yield pd.DataFrame({"length": int(n), "tree": t, "leaf": tree.leaves(x), "embedding": part["embedding"], "ids": part["ids"]})

    where = "length int, tree int, leaf long"
    indexed = distinct.mapInPandas(fall, f"{where}, embedding array<double>, ids array<long>")
    counts = distinct.mapInPandas(lambda bs: (x[["length", "tree", "leaf"]] for x in fall(bs)), where).groupBy("length", "tree", "leaf").count().collect()  # bounded by the forest
    sizes: dict[int, dict[tuple[int, int], int]] = {}
    for c in counts:
        sizes.setdefault(c.length, {})[c.tree, c.leaf] = c["count"]
    held = spark.sparkContext.broadcast(sizes)
    tried = [(r.vec_id, np.asarray(r.embedding)) for r in rows.filter(is_query).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(probes).collect()]
    true: dict[int, list[list[float]]] = {}
    for r in exact(rows, tried, k).collect() if tried else []:  # k rows a probe
        true.setdefault(r.query_id, []).append(r.embedding)
    costs = sorted(c for q, e in tried if q in true for c in needed_budget(trees_for(len(e)), sizes.get(len(e), {}), e.astype(np.float32), np.array(true[q], np.float32)))
    budget = costs[min(len(costs) - 1, int(target * len(costs)))] if costs else 1

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, e in zip(b["vec_id"], b["embedding"], strict=True):
                n = len(e)
                known = held.value.get(n, {})
                for t, leaf_ in search(trees_for(n), known, e.astype(np.float32), budget):
                    out += [(n, t, leaf_, s, q, e) for s in range(-(-known[t, leaf_] // ROWS))]
            yield pd.DataFrame(out, columns=["length", "tree", "leaf", "salt", "query_id", "query"])

    def salted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blocks = [-(-held.value[n][t, f] // ROWS) for n, t, f in zip(b["length"], b["tree"], b["leaf"], strict=True)]
            yield b.assign(salt=b["ids"].map(lambda i: hash(int(i[0]) * 0x9E3779B97F4A7C15 & 0xFFFFFFFF)) % np.array(blocks, np.int64))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x = np.stack(right["embedding"])
        ids = right["ids"].to_numpy()
        first = np.array([i[0] for i in ids])
        out = []
        for q, e in zip(left["query_id"], left["query"], strict=True):
            d = np.sqrt(((x - e) ** 2).sum(1))
            # k + 1 vectors: the query's own may be one; ties at the end stay in
            near = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
            near = np.flatnonzero(d <= d[near].max())
            near = near[np.lexsort((first[near], d[near]))][: max(k + 1, 64)] if len(near) > 4 * k else near
            found = sorted((d[j], i) for j in near for i in ids[j] if i != q)[:k]
            out += [(q, i, s) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    queries = rows.filter(is_query).repartition(parts).mapInPandas(walk, f"{where}, salt long, query_id long, query array<double>")
    blocks = indexed.mapInPandas(salted, f"{where}, embedding array<double>, ids array<long>, salt long")
    keys = ["length", "tree", "leaf", "salt"]
    found = queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
