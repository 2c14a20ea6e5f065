"""Nearest neighbours by cosine through low-dimensional stable projections and kd-trees.

Vectors of length 1 are projected on ``DIMS`` Gaussian (2-stable) directions: the squared distance of two projections, divided by the
squared distance of the vectors, follows a chi-square law with ``DIMS`` degrees of freedom. Each block of candidates is indexed by a kd-tree
over its projections. A query visits the leaves in the order of their least possible projected distance and verifies their
vectors exactly; it stops when even the nearest unvisited projection is farther than the chi-square quantile ``SURE`` allows for a
vector as near as the k-th found so far.

Every candidate is in one block's index. The query set meets the candidates block against block, and each pair of blocks hands on
at most k rows a query.
"""
from __future__ import annotations


from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


DIMS, LEAF, SURE = 8, 32, 0.97
CANDIDATES, QUERIES = 20_000, 4_000  # rows of a block
LONG = T.LongType()


def chi_square_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma P(k/2, x/2), by its series."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= y / n
        total += term
    return total * exp(-y + a * log(y) - lgamma(a))


def chi_square_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 50.0 + 10 * k
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, k) < p else (lo, mid)
    return hi


class KdTree:
    """Points in leaves of at most ``LEAF``, by cutting the widest dimension at its median; boxes are those of the points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf:
                bounds.append((lo, hi))
                continue
            part = points[self.order[lo:hi]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, axis], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        bounds.sort()
        self.start = np.array([b[0] for b in bounds] + [len(points)])
        placed = points[self.order]
        self.low = np.minimum.reduceat(placed, self.start[:-1], axis=0)
        self.high = np.maximum.reduceat(placed, self.start[:-1], axis=0)

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Least squared distance of each leaf's box."""
        away = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", away, away)


def cosines(rows: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Row by row in double precision, so that equal vectors get equal scores wherever they lie."""
    return (rows * q).sum(1) / (norms * q_norm)


class Block:
    """Index over one block of candidates. Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, dims: int, seed: int):
        order = np.lexsort((ids, *vectors.T[::-1])) if len(ids) else np.zeros(0, np.int64)
        ids, vectors = ids[order], vectors[order]
        once = np.concatenate([[True], (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(1)])[:len(ids)]
        ids, vectors = ids[once], vectors[once]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])[:len(ids)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        keep = np.arange(len(ids)) - first <= k
        ids, vectors = ids[keep], vectors[keep]
        norms = np.sqrt((vectors * vectors).sum(1))
        self.axes = np.random.default_rng(seed).normal(size=(vectors.shape[1], dims))
        points = (vectors / norms[:, None]) @ self.axes
        self.tree = KdTree(points)
        self.ids, self.vectors, self.norms = ids[self.tree.order], vectors[self.tree.order], norms[self.tree.order]

    def nearest(self, q_id: int, q: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k nearest found."""
        q_norm = float(np.sqrt((q * q).sum()))
        away = self.tree.leaf_distances((q / q_norm) @ self.axes)
        leaves = np.argsort(away, kind="stable")
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 8
        while at < len(leaves):
            if len(best) == k and away[leaves[at]] > limit * max(2 - 2 * best[-1], 0.0) + 1e-12:
                break
            some = leaves[at:at + step]
            rows = np.concatenate([np.arange(self.tree.start[x], self.tree.start[x + 1]) for x in some])
            score, ids = cosines(self.vectors[rows], self.norms[rows], q, q_norm), self.ids[rows]
            own = ids != q_id
            best, best_ids = np.concatenate([best, score[own]]), np.concatenate([best_ids, ids[own]])
            top = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[top], best_ids[top]
            at, step = at + step, min(step * 2, 64)
        return best_ids, best


FOUND = T.StructType([T.StructField("query_id", LONG), T.StructField("vec_id", LONG), T.StructField("score", T.DoubleType())])


def _search(k: int, dims: int, sure: float, seed: int):
    limit = chi_square_quantile(sure, dims)

    def scan(key: tuple, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        if queries.num_rows and corpus.num_rows:
            q, c = (np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (queries, corpus))
            block = Block(np.asarray(corpus.column("id")), c, k, dims, seed)
            q_ids = np.asarray(queries.column("id"))
            once = list({(i, x.tobytes()): n for n, (i, x) in enumerate(zip(q_ids.tolist(), q))}.values())
            q_ids, q = q_ids[once], q[once]
            found = [block.nearest(int(i), x, k, limit) for i, x in zip(q_ids, q)]
            out = [np.repeat(q_ids, [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return scan


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): ids and vectors in double precision; without null ids, null, empty or zero vectors, or null or non-finite components."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & good)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            dims: int = DIMS, sure: float = SURE, seed: int = 17) -> DataFrame:
    """The k nearest found for each query: query_id, rank (from 1), vec_id, score (cosine on the given vectors, double precision).

    Nearest first, ties to the smaller id; all other candidates if there are fewer than k. A row is no candidate of a query with its own id.
    Unusable vectors take no part (see ``usable``). A query meets the candidates of its own dimension. Rows that repeat an id and a vector count
    once as candidates and as queries. Empty tables give no rows. Other columns are ignored.
    """
    c = usable(corpus, id_col, vec_col).withColumn("n", F.size("v"))
    q = usable(queries, id_col, vec_col).withColumn("n", F.size("v"))
    parts = lambda df, most, name: df.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    # one row for each dimension: fewer than the square root of twice the components, however many vectors there are
    sizes = F.broadcast(parts(c, CANDIDATES, "blocks").join(parts(q, QUERIES, "groups"), "n"))
    here = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    side = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(sizes, "n").select("n", "id", "v", here("groups").alias("g"), side("blocks").alias("b"))
    right = c.join(sizes, "n").select("n", "id", "v", here("blocks").alias("b"), side("groups").alias("g"))
    found = left.groupBy("n", "g", "b").cogroup(right.groupBy("n", "g", "b")).applyInArrow(_search(k, dims, sure, seed), FOUND)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)  # at most k rows a block
    top = found.groupBy("query_id").agg(best.alias("top")).select("query_id", F.posexplode("top").alias("p", "x"))
    return top.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
