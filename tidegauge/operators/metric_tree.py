"""Exact nearest vectors without all pairs: a metric tree of sampled pivots, pruned by the triangle inequality."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.vectors import corpus_blocks, inverted, query_blocks, ranked, search_blocks
from tidegauge.session import settle

PIVOT_BYTES = 32 << 20  # what the pivots of a broadcast tree may take; fewer pivots make larger cells, never other results


def points(mat: np.ndarray, metric: str, side: int) -> np.ndarray:
    """Rows whose Euclidean distance orders like the metric. For cosines, unit vectors: their distance is sqrt(2 - 2 cos).

    A zero vector has cosine 0 with everything: it gets an axis of its own, one for the corpus (``side`` 0), one for the queries (1).
    """
    if metric == "euclid":
        return mat
    length = np.linalg.norm(mat, axis=1)
    axes = np.zeros((len(mat), 2))
    axes[length == 0, side] = 1.0
    return np.hstack([mat / np.where(length > 0, length, 1.0)[:, None], axes])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0.0))


def matrix(vectors: Sequence, width: int) -> np.ndarray:
    return np.concatenate([np.asarray(v, np.float64) for v in vectors]).reshape(-1, width) if len(vectors) else np.zeros((0, width))


class Tree:
    """Pivots in two levels. A row goes to its nearest top and there to the nearest leaf; radii cover the rows that went there."""

    def __init__(self, pivots: np.ndarray, seed: int = 42):
        self.leaf = np.unique(pivots, axis=0)
        n = len(self.leaf)
        self.top = self.leaf[np.sort(np.random.default_rng(seed).permutation(n)[:math.ceil(math.sqrt(n))])]
        above = distances(self.leaf, self.top).argmin(1)
        order = above.argsort(kind="stable")  # leaves under one top get neighbouring numbers, so that rows in leaf order lie together
        self.leaf, self.above = self.leaf[order], above[order]
        self.under = [np.flatnonzero(self.above == t) for t in range(len(self.top))]
        self.count, self.radius, self.reach = np.zeros(n, np.int64), np.full(n, -np.inf), np.full(len(self.top), -np.inf)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to it, distance to the top above it) of each row."""
        to_top = distances(x, self.top)
        top = to_top.argmin(1)
        cell, d = np.zeros(len(x), np.int64), np.zeros(len(x))
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            leaves = self.under[t] if len(self.under[t]) else np.arange(len(self.leaf))  # rounding may give a top's own pivot to a neighbour
            near = distances(x[rows], self.leaf[leaves])
            best = near.argmin(1)
            cell[rows], d[rows] = leaves[best], near[np.arange(len(rows)), best]
        return cell, d, to_top[np.arange(len(x)), self.above[cell]]

    def homes(self, x: np.ndarray, need: int) -> list[np.ndarray]:
        """For each query, near leaves that hold ``need`` rows together (all leaves, if they hold fewer)."""
        top, out = distances(x, self.top).argmin(1), [None] * len(x)
        for t in np.unique(top):
            rows, leaves, held = np.flatnonzero(top == t), [], 0
            for u in distances(self.top[t:t + 1], self.top)[0].argsort(kind="stable"):
                leaves.append(self.under[u])
                held += self.count[self.under[u]].sum()
                if held >= need:
                    break
            leaves = np.concatenate(leaves)
            leaves = leaves[self.count[leaves] > 0]
            order = leaves[distances(x[rows], self.leaf[leaves]).argsort(1, kind="stable")]
            before = self.count[order].cumsum(1) - self.count[order]
            for r, cells, keep in zip(rows, order, before < need):
                out[r] = cells[keep]
        return out

    def visits(self, x: np.ndarray, limit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries) for which the leaf may hold a row within the query's limit: no row is nearer than d(query, pivot) - radius."""
        size = np.linalg.norm(x, axis=1)
        for t, leaves in enumerate(self.under):
            leaves = leaves[self.count[leaves] > 0]
            d = distances(x, self.top[t:t + 1])[:, 0]
            rows = np.flatnonzero(d - self.reach[t] <= limit + 1e-6 * (1 + size + d))
            if len(rows) and len(leaves):
                d = distances(x[rows], self.leaf[leaves])
                near = d - self.radius[leaves] <= (limit[rows] + 1e-6 * (1 + size[rows]))[:, None] + 1e-6 * d
                for j in np.flatnonzero(near.any(0)):
                    yield int(leaves[j]), rows[near[:, j]]


class MetricIndex:
    """A corpus in the cells of a metric tree; ``top_k`` gives the same rows as comparing all pairs.

    Pivots are a hashed sample, about the square root of the rows and at most ``PIVOT_BYTES``; a row with a null key or vector takes no part. Rows
    and queries are written once, in the order of their cells, as blocks of bounded size (a hot cell is many blocks). A query is first compared with
    the cells around it, which gives a k-th score; then with the cells whose bound can beat or equal that score. In the worst case (no structure)
    these are all cells: then the comparisons are those of all pairs, but what moves is still each block once and the hits.
    Vectors have one length; keys of queries are expected once.
    """

    def __init__(self, corpus: DataFrame, key: str, vec: str, metric: str = "cosine"):
        self.spark, self.key, self.vec, self.metric = corpus.sparkSession, key, vec, metric
        rows = self._rows(corpus, "id")
        known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
        self.n, self.width = known["n"], known["width"] or 0
        if not self.n:
            return
        width, metric = self.width, self.metric
        want = max(1, min(math.ceil(math.sqrt(self.n)), PIVOT_BYTES // (8 * (width + 2))))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(want).select("v").collect()  # bounded by PIVOT_BYTES
        tree = Tree(points(matrix([r["v"] for r in sample], width), metric, 0))
        shared = self.spark.sparkContext.broadcast(tree)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                cell, d, high = shared.value.place(points(matrix(b["v"], width), metric, 0))
                yield b.assign(cell=cell, d=d, high=high)

        placed = settle(rows.mapInPandas(place, "id long, v array<double>, cell int, d double, high double"), "placed")
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r"), F.max("high").alias("high")).collect():  # one row per pivot at most
            top = tree.above[r["cell"]]
            tree.count[r["cell"]], tree.radius[r["cell"]], tree.reach[top] = r["n"], r["r"], max(tree.reach[top], r["high"])
        self.tree = self.spark.sparkContext.broadcast(tree)
        self.blocks = corpus_blocks(placed, metric)

    def _rows(self, df: DataFrame, name: str) -> DataFrame:
        v = F.transform(self.vec, lambda x: x.cast("double"))
        return df.select(F.col(self.key).cast("long").alias(name), v.alias("v")).where(F.col(name).isNotNull() & F.col("v").isNotNull())

    def plan(self, queries: DataFrame, k: int, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
        """Query blocks with the cells around each query, and with all cells that can hold one of its k best."""
        width, metric, tree = self.width, self.metric, self.tree
        need = k + 1 if exclude_self else k

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = points(matrix(b["v"], width), metric, 1)
                yield b.assign(cell=tree.value.place(x)[0], homes=tree.value.homes(x, need))

        def within(b: pd.DataFrame, lo: int, hi: int):
            score = b["floor"].iloc[lo:hi].fillna(-np.inf).to_numpy(np.float64)
            far = np.sqrt(np.maximum(2 - 2 * score, 0.0)) if metric == "cosine" else -score
            return tree.value.visits(points(matrix(b["v"].iloc[lo:hi], width), metric, 1), far)

        asked = settle(self._rows(queries, "qid").mapInPandas(home, "qid long, v array<double>, cell int, homes array<int>"), "homes")
        first = query_blocks(asked, "int", metric, lambda b, lo, hi: inverted(b["homes"].iloc[lo:hi]))
        hits = ranked(search_blocks(self.blocks, first, k, metric, exclude_self), k)
        floors = settle(hits.where(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.col("score").alias("floor")), "floors")
        return first, query_blocks(asked.drop("homes").join(floors, "qid", "left"), "int", metric, within)

    def top_k(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """(query_id, key, score, rank), ties to the smaller key."""
        if not self.n:
            return self.spark.createDataFrame([], f"query_id long, `{self.key}` long, score double, rank int")
        later = self.plan(queries, k, exclude_self)[1]
        return ranked(search_blocks(self.blocks, later, k, self.metric, exclude_self), k).withColumnRenamed("key", self.key)

    def pairs(self, queries: DataFrame, k: int, exclude_self: bool = False) -> int:
        """Pairs of vectors that ``top_k`` compares."""
        tree = self.tree

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for want, bits in zip(b["want"], b["bits"]):
                    asked = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(want), -1), axis=1).sum(1, dtype=np.int64)
                    yield pd.DataFrame({"n": [int((asked * tree.value.count[np.asarray(want, np.int64)]).sum())]})

        first, later = self.plan(queries, k, exclude_self)
        return first.union(later).select("want", "bits").mapInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
