"""Vector functions and exact or cell-based similarity search."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.ordering import as_col, attach, let
from tidegauge.session import settle

QUERY_BLOCK = 2048  # query vectors packed into one row: bounds the matrix a task holds
CORPUS_BLOCK = 4096  # the same for the vectors they are compared with
BLOCK_BYTES = 4 << 20  # and for both, where vectors are long


def dot(a: Column | str, b: Column | str) -> Column:
    prod = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclid(a: Column | str, b: Column | str) -> Column:
    sq = F.zip_with(as_col(a), as_col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def unit(a: Column | str) -> Column:
    """The vector divided by its length (zero vectors stay zero)."""
    return let(norm(a), lambda n: F.transform(as_col(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows divided by their length (zero rows stay zero)."""
    length = np.linalg.norm(m, axis=1)
    return m / np.where(length > 0, length, 1.0)[:, None]


def _cuts(widths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of vectors of one length, of at most ``size`` rows and ``BLOCK_BYTES``."""
    ends = [*(np.flatnonzero(np.diff(widths)) + 1), len(widths)]
    lo = 0
    for end in ends:
        step = max(1, min(size, BLOCK_BYTES // (8 * max(int(widths[lo]) if len(widths) else 1, 1))))
        for at in range(lo, end, step):
            yield at, min(end, at + step)
        lo = end


def _matrix(vectors, metric: str) -> np.ndarray:
    m = np.concatenate([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1 if len(vectors[0]) else 0)
    return scaled(m) if metric == "cosine" else m


def corpus_blocks(rows: DataFrame, metric: str) -> DataFrame:
    """``rows`` (cell, id, v) in the order of their cells, packed: a row holds up to ``CORPUS_BLOCK`` vectors and where each cell starts."""
    size = CORPUS_BLOCK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, ids, v = b["cell"].to_numpy(), b["id"].to_numpy(np.int64), b["v"].to_numpy()
            for lo, hi in _cuts(np.fromiter(map(len, v), np.int64, len(v)), size):
                part = cell[lo:hi]
                start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                yield pd.DataFrame({"cells": [part[start]], "starts": [start.astype(np.int32)], "ids": [ids[lo:hi].tobytes()], "mat": [_matrix(v[lo:hi], metric).tobytes()]})

    kind = rows.schema["cell"].dataType.simpleString()
    sorted_ = rows.select("cell", "id", "v").repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell")
    return settle(sorted_.mapInPandas(run, f"cells array<{kind}>, starts array<int>, ids binary, mat binary"), "corpus-blocks")


def query_blocks(rows: DataFrame, kind: str, metric: str, wants) -> DataFrame:
    """``rows`` (cell, qid, v, ...) in the order of ``cell``, packed: a row holds up to ``QUERY_BLOCK`` vectors and, for each cell of type ``kind`` that
    ``wants(batch, first, last)`` lists as (cell, rows), one bit a vector. A column ``floor`` is the least score that may still matter."""
    size = QUERY_BLOCK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, v = b["qid"].to_numpy(np.int64), b["v"].to_numpy()
            floor = b["floor"].fillna(-np.inf).to_numpy(np.float64) if "floor" in b else np.full(len(b), -np.inf)
            for lo, hi in _cuts(np.fromiter(map(len, v), np.int64, len(v)), size):
                found = list(wants(b, lo, hi))
                bits = np.zeros((len(found), hi - lo), bool)
                for i, (_, at) in enumerate(found):
                    bits[i, at] = True
                yield pd.DataFrame({"want": [[c for c, _ in found]], "bits": [np.packbits(bits, axis=1).tobytes()], "floor": [floor[lo:hi].tobytes()],
                                    "qids": [ids[lo:hi].tobytes()], "qmat": [_matrix(v[lo:hi], metric).tobytes()]})

    sorted_ = rows.repartitionByRange("cell", F.xxhash64("qid")).sortWithinPartitions("cell")
    packed = sorted_.mapInPandas(run, f"want array<{kind}>, bits binary, floor binary, qids binary, qmat binary")
    return settle(packed.withColumn("block", F.monotonically_increasing_id()), "query-blocks")


class Best:
    """The k best so far of each query of one block."""

    def __init__(self, r, k: int, metric: str, exclude_self: bool):
        self.block, self.k, self.metric, self.exclude_self = r.block, k, metric, exclude_self
        self.ids, self.floor = np.frombuffer(r.qids, np.int64), np.frombuffer(r.floor, np.float64).copy()
        n = len(self.ids)
        self.q = np.frombuffer(r.qmat, np.float64).reshape(n, -1 if len(r.qmat) else 0)
        self.rough, self.square = self.q.astype(np.float32), (self.q * self.q).sum(1)
        bits = np.frombuffer(r.bits, np.uint8).reshape(len(r.want), -1)
        self.rows = {c: np.flatnonzero(np.unpackbits(b, count=n)) for c, b in zip(r.want, bits)}
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def exact(self, rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Row by row, so that equal vectors get equal scores wherever they lie."""
        a = self.q[rows]
        return (a * c).sum(1) if self.metric == "cosine" else -np.sqrt(((a - c) ** 2).sum(1))

    def near(self, rows: np.ndarray, ids: np.ndarray, order: np.ndarray, c: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in ``rows``, in ``c``) of the pairs that may be among the k best: a matrix product and one comparison.

        Unit vectors are multiplied in single precision, whose error the slack covers; ``exact`` then scores what is left.
        """
        floor = self.floor[rows]
        if self.metric == "cosine":
            s = self.rough[rows] @ c.T
            slack = np.full(len(rows), 2e-7 * (c.shape[1] + 8))
        else:
            s = -np.sqrt(np.maximum(self.square[rows][:, None] + square[None, :] - 2 * (self.q[rows] @ c.T), 0.0))
            slack = 1e-6 * (1 + np.sqrt(self.square[rows]) + np.where(np.isfinite(floor), np.abs(floor), 0.0))
        if np.isnan(square.sum()) or np.isnan(self.square.sum()):
            s[np.isnan(s)] = -np.inf
        if self.exclude_self:
            lo, hi = (np.searchsorted(ids[order], self.ids[rows], side) for side in ("left", "right"))
            for i in np.flatnonzero(hi > lo):
                s[i, order[lo[i]:hi[i]]] = -np.inf
        low = np.maximum(floor - slack, -3e38).astype(s.dtype)
        keep = s >= low[:, None]
        if s.shape[1] > self.k and np.count_nonzero(keep) > max(4 * self.k * len(rows), s.size // 16):
            cut = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]  # no more than the k best of these, and their ties
            if self.metric == "cosine":
                slack *= 2  # the cut is rounded as well
            else:
                slack = 2e-6 * (1 + np.sqrt(self.square[rows]) + np.where(np.isfinite(cut), np.abs(cut), 0.0))
            keep = s >= np.maximum(low, cut - slack.astype(s.dtype))[:, None]
        return np.nonzero(keep)

    def shared(self, r, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last, rows) of the cells of a corpus block that rows of this one want; neighbouring cells that all rows want are one."""
        held = None
        for cell, lo, hi in zip(r.cells, r.starts, [*r.starts[1:], size]):
            rows = self.rows.get(cell)
            if rows is None:
                continue
            if held and held[1] == lo and len(held[2]) == len(rows) == len(self.ids):
                held = held[0], hi, rows
                continue
            if held:
                yield held
            held = lo, hi, rows
        if held:
            yield held

    def meet(self, r) -> None:
        """Compare the block with a corpus block, in the cells they share."""
        ids = np.frombuffer(r.ids, np.int64)
        c = np.frombuffer(r.mat, np.float64).reshape(len(ids), -1 if len(r.mat) else 0)
        rough, square, new = c.astype(np.float32) if self.metric == "cosine" else c, (c * c).sum(1), [self.found]
        for lo, hi, rows in self.shared(r, len(ids)):
            order = ids[lo:hi].argsort(kind="stable")
            for at in range(0, len(rows), 256):
                part = rows[at:at + 256]
                qi, ci = self.near(part, ids[lo:hi], order, rough[lo:hi], square[lo:hi])
                for x in range(0, len(qi), 1 << 16):
                    i, j = part[qi[x:x + (1 << 16)]], lo + ci[x:x + (1 << 16)]
                    new.append((i, ids[j], self.exact(i, c[j])))
        if sum(len(i) for i, _, _ in new[1:]):
            row, key, score = (np.concatenate(x) for x in zip(*new))
            order = np.lexsort((key, -score, row))
            row, key, score = row[order], key[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = place == self.k - 1
            self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])
            self.found = row[place < self.k], key[place < self.k], score[place < self.k]

    def hits(self) -> pd.DataFrame:
        row, key, score = self.found
        return pd.DataFrame({"query_id": self.ids[row], "key": key, "score": score})


def search_blocks(corpus: DataFrame, queries: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """(query_id, key, score): the k best of every part of the corpus for each query, of the pairs of blocks that share a wanted cell.

    Both sides are read from the shared folder, part against part; nothing is shuffled but the hits. In one task the pairs of a query block
    follow each other, so the k best so far raise its floor; were they mixed, more hits would be handed on, never others lost.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            for r in b.itertuples(index=False):
                if best is None or best.block != r.block:
                    if best is not None:
                        yield best.hits()
                    best = Best(r, k, metric, exclude_self)
                best.meet(r)
        if best is not None:
            yield best.hits()

    met = queries.join(corpus.hint("shuffle_replicate_nl"), F.arrays_overlap("want", "cells"))
    return met.mapInPandas(run, "query_id long, key long, score double")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def inverted(lists) -> Iterator[tuple]:
    """(cell, rows) for one list of cells a row."""
    lists = list(lists)
    rows, cells = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.asarray(x) for x in lists])
    order = cells.argsort(kind="stable")
    for part in np.split(order, np.flatnonzero(cells[order][1:] != cells[order][:-1]) + 1):
        if len(part):
            yield cells[part[0]], rows[part]


def top_k(queries: DataFrame, corpus: DataFrame, key: str, vec: str, k: int, metric: str = "cosine",
          exclude_self: bool = False, by: str | None = None) -> DataFrame:
    """Exact top-k per query: (query_id, key, score, rank), ties to the smaller key.

    ``metric`` is ``cosine`` (larger is nearer) or ``euclid`` (score is minus the distance). The whole corpus is searched through the cells of a
    metric tree (``metric_tree``, which runs jobs when called). ``by`` restricts the search to the query's own group instead, or, where the queries'
    column is an array, to all groups it names. Both sides are sorted by group and written as blocks of bounded size; blocks with a common group
    meet as matrix products that keep only the k best. What is shuffled is each side once and the hits, never a row per pair or group.
    A row with a null key, vector or group takes no part.
    """
    for side in (queries, corpus):
        if not isinstance(side.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            raise TypeError(f"top_k needs an integer key, not {side.schema[key].dataType.simpleString()}")
    if by is None:
        from tidegauge.operators.metric_tree import MetricIndex

        return MetricIndex(corpus, key, vec, metric).top_k(queries, k, exclude_self)
    several = isinstance(queries.schema[by].dataType, T.ArrayType)  # a query may name several groups
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    named = queries.schema[by].dataType.elementType if several else queries.schema[by].dataType
    kind = "bigint" if isinstance(named, whole) and isinstance(corpus.schema[by].dataType, whole) else "string"
    groups = F.col(by).cast(f"array<{kind}>") if several else F.array(F.col(by).cast(kind))
    numbers = lambda: F.transform(vec, lambda x: x.cast("double")).alias("v")
    usable = lambda df: df.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & F.col(by).isNotNull())
    q = usable(queries).select(F.get(groups, F.lit(0)).alias("cell"), groups.alias("groups"), F.col(key).cast("long").alias("qid"), numbers())
    c = usable(corpus).select(F.col(by).cast(kind).alias("cell"), F.col(key).cast("long").alias("id"), numbers())
    blocks = query_blocks(q, kind, metric, lambda b, lo, hi: inverted(b["groups"].iloc[lo:hi]))
    hits = search_blocks(corpus_blocks(c, metric), blocks, k, metric, exclude_self)
    return ranked(hits, k).withColumnRenamed("key", key)


def top_k_cosine(queries: DataFrame, corpus: DataFrame, key: str, vec: str, k: int, exclude_self: bool = False) -> DataFrame:
    return top_k(queries, corpus, key, vec, k, "cosine", exclude_self)


def analogy(a: Column | str, b: Column | str, c: Column | str) -> Column:
    """Unit vector of a - b + c."""
    diff = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return unit(F.zip_with(diff, as_col(c), lambda x, y: x + y.cast("double")))


def quantize_int8(df: DataFrame, vec: str, name: str) -> DataFrame:
    """Vectors as bytes, scaled by the largest absolute element of the whole table."""
    scale = df.agg(F.max(F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))).alias("m"))
    return attach(df, scale, "_q").withColumn(
        name, F.transform(vec, lambda x: F.round(x.cast("double") / F.col("_q.m") * 127).cast("tinyint"))).drop("_q")
