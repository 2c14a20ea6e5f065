"""Cell-based (inverted-file) approximate search."""
from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.vectors import top_k, unit
from tidegauge.session import settle

CENTRE_BYTES = 32 << 20  # what the centres may take in every task; beyond it cells grow instead of their number
FIT_PER_CELL = 256  # vectors a cell that the centres are fitted on; every vector is placed


def cell_count(n: int, dim: int) -> int:
    """About the square root of the corpus, so that a query's cells hold about ``nprobe`` times the root, not a fixed share of the table."""
    return max(1, min(isqrt(n), CENTRE_BYTES // (8 * max(dim, 1))))


def build_cells(corpus: DataFrame, key: str, vec: str, cells: int | None, path: str, seed: int = 42):
    """K-means cells on unit vectors; the corpus is written with its cell, ready for equi-joins. ``cells`` None: by ``cell_count``."""
    u = settle(corpus.select(key, unit(vec).alias("u")), "unit-vectors")
    size = u.agg(F.count("u").alias("n"), F.max(F.size("u")).alias("dim")).first()
    if cells is None:
        cells = cell_count(size["n"], size["dim"] or 1)
    share = FIT_PER_CELL * cells / max(size["n"], 1)
    f = u.withColumn("f", array_to_vector("u"))
    model = KMeans(k=cells, seed=seed, featuresCol="f", predictionCol="cell", maxIter=15).fit(f if share >= 1 else f.sample(fraction=share, seed=seed))
    model.transform(f).select(key, "u", "cell").write.mode("overwrite").parquet(path)
    return model, corpus.sparkSession.read.parquet(path)


def cell_order(model, queries: DataFrame, key: str, vec: str, nprobe: int) -> DataFrame:
    """(key, u, cells): the unit vector and its ``nprobe`` nearest cells, nearest first, by a matrix product for 256 queries at a time."""
    centres = np.array(model.clusterCenters())
    half = (centres * centres).sum(axis=1) / 2
    q = queries.select(key, unit(vec).alias("u")).where("u is not null")

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i:i + 256]
                near = np.stack(part["u"].to_numpy()) @ centres.T - half
                yield part.assign(cells=list(np.argsort(-near, axis=1, kind="stable")[:, :nprobe].astype(np.int32)))

    kind = q.schema[key].dataType.simpleString()
    return q.mapInPandas(order, f"`{key}` {kind}, u array<double>, cells array<int>")


def probes_for(model, sample: DataFrame, corpus: DataFrame, indexed: DataFrame, key: str, vec: str, k: int, target: float = 0.95, exclude_self: bool = False) -> int:
    """Least number of probed cells that finds ``target`` of the exact hits of ``sample``, a bounded set of queries held against all rows.

    An exact hit is found when its cell is among those probed, so the place of its cell in the query's order tells all numbers at once.
    """
    cells = len(model.clusterCenters())
    hits = top_k(sample, corpus, key, vec, k, "cosine", exclude_self).select("query_id", key)
    order = cell_order(model, sample, key, vec, cells).select(F.col(key).alias("query_id"), F.col("cells").alias("order"))
    at = hits.join(indexed.select(key, "cell"), key).join(order, "query_id").groupBy(F.array_position("order", F.col("cell")).alias("at")).count()
    found = sorted((r["at"], r["count"]) for r in at.collect())  # one row a cell at most
    total, upto = sum(c for _, c in found), 0
    for place, c in found:
        upto += c
        if upto >= target * total:
            return int(place)
    return 1


def probe(model, queries: DataFrame, indexed: DataFrame, key: str, vec: str, k: int, nprobe: int, exclude_self: bool = False) -> DataFrame:
    """Top-k among the vectors of each query's nearest cells."""
    q = cell_order(model, queries, key, vec, nprobe).select(key, "u", F.col("cells").alias("cell"))
    return top_k(q, indexed, key, "u", k, "cosine", exclude_self, by="cell")


def recall_against(exact: DataFrame, approx: DataFrame, key: str) -> DataFrame:
    """Share of the exact hits found, per query."""
    found = approx.select("query_id", key, F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", key], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
