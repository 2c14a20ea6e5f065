"""Augmented Dickey-Fuller test with the lag order chosen by information criterion, and its tail probability."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.moments import vector_sums

# MacKinnon's published response surface of the tail probability, one series with a constant
TAU_SPLIT, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    surface = TAU_SMALL if stat <= TAU_SPLIT else TAU_LARGE
    return 0.5 * math.erfc(-sum(c * stat**i for i, c in enumerate(surface)) / math.sqrt(2))


def most_lags(n: int) -> int:
    """Largest lag order tried for a series of n values (negative: too short for the test)."""
    return min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))


def prefix_residuals(xx: np.ndarray, xy: np.ndarray, yy: float) -> np.ndarray:
    """Residual sums of squares of the regressions on the first 1, 2, ... columns, from one Cholesky factor of the moment matrix."""
    z = np.linalg.solve(np.linalg.cholesky(xx), xy)
    return yy - np.cumsum(z * z)


def augmented_dickey_fuller(df: DataFrame, series: str, t: str, y: str, level: float = 0.05) -> DataFrame:
    """(series, n, lags, stat, p, stationary) per series: regression of the change on a constant, the last value and ``lags`` earlier changes.

    The order is that of least AIC among 0 .. ``most_lags``, all judged on the rows that have every lag (ties to the smaller); the statistic then
    uses all rows that the chosen order leaves. One scan gives a series' moment matrix and its first rows, which are as many as lags; every order
    comes from prefixes of one Cholesky factor. Null values are left out. A series too short (fewer than four values) or without
    variation has null results. Rows of one series pass one window in order.
    """
    kind = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)[series]
    rows = df.select(F.col(series).alias("s"), F.col(t).alias("t"), F.col(y).cast("double").alias("y")).where("y is not null")
    longest = rows.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    top = max(most_lags(longest), 0)
    width = top + 3  # constant, last value, changes, target
    every = Window.partitionBy("s")
    ordered = every.orderBy("t")
    z = rows.select("s", "t", F.count(F.lit(1)).over(every).alias("n"), F.row_number().over(ordered).alias("pos"),
                    F.try_divide(F.col("y") - F.avg("y").over(every), F.stddev_pop("y").over(every)).alias("z"))
    recent = F.collect_list("z").over(ordered.rowsBetween(-(top + 1), 0))
    z = z.select("s", "n", "pos", recent.alias("recent"))

    def parts(b: pd.DataFrame) -> Iterator[tuple[tuple, np.ndarray]]:
        for (s, n), g in b.groupby(["s", "n"], sort=False, dropna=False):
            lags = most_lags(n)
            g = g[(g["pos"] >= 2) & (g["recent"].map(len) == np.minimum(g["pos"], top + 2))]
            out = np.zeros(width * width + top * width)
            if lags >= 0 and len(g):
                past = np.zeros((len(g), top + 2))
                for i, v in enumerate(g["recent"]):
                    past[i, -len(v):] = v
                pos = g["pos"].to_numpy()
                change = np.diff(past, axis=1)[:, ::-1]  # this row's, then older ones
                change[np.arange(top + 1)[None, :] + 2 > pos[:, None]] = 0.0
                x = np.column_stack([np.ones(len(g)), past[:, -2], change[:, 1:], change[:, 0]])
                full = pos >= lags + 2
                out[:width * width] = (x[full].T @ x[full]).ravel()
                early = out[width * width:].reshape(top, width)
                early[pos[~full] - 2] = x[~full]
            yield (None if pd.isna(s) else s, int(n)), out

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(s, *fit(n, np.asarray(v))) for s, n, v in zip(b["s"], b["n"], b["sums"])], columns=["s", "n", "lags", "stat", "p", "stationary"])

    def fit(n: int, sums: np.ndarray) -> tuple:
        lags = most_lags(n)
        none = (None, None, None, None, None)
        if lags < 0:
            return none
        m, early = sums[:width * width].reshape(width, width), sums[width * width:].reshape(top, width)
        used = n - 1 - lags
        try:
            left = prefix_residuals(m[:lags + 2, :lags + 2], m[:lags + 2, -1], m[-1, -1])[1:]
            aic = used * np.log(np.maximum(left, 1e-300) / used) + 2 * np.arange(2, lags + 3)
            q = int(aic.argmin())
            more = early[q:lags]
            m = m + more.T @ more
            xx, xy = m[:q + 2, :q + 2], m[:q + 2, -1]
            beta = np.linalg.solve(xx, xy)
            used = n - 1 - q
            s2 = (m[-1, -1] - beta @ xy) / (used - (q + 2))
            stat = float(beta[1] / np.sqrt(s2 * np.linalg.inv(xx)[1, 1]))
        except (np.linalg.LinAlgError, ZeroDivisionError):
            return none
        if not math.isfinite(stat):
            return none
        p = unit_root_p(stat)
        return used, q, stat, p, p < level

    sums = vector_sums(z, {"s": kind, "n": "long"}, parts)
    return sums.mapInPandas(solve, f"s {kind}, n long, lags int, stat double, p double, stationary boolean").withColumnRenamed("s", series)
