"""Selection leak on pure noise at full size: one scan for all F scores, one scan a Newton step for all models together."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.moments import vector_sums
from tidegauge.operators.splits import stratified_folds
from tidegauge.session import settle

SLICE = 2_048  # rows whose noise is in memory at a time


def noise_columns(keys: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Standard normal noise of (row key, column number): a mixed 64-bit counter, its halves turned by Box and Muller."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + (columns.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        # fixed values: multipliers and shifts of the public splitmix64 finaliser
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    a = ((x >> np.uint64(32)).astype(np.float64) + 0.5) / 2**32
    b = (x & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32
    return np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)


def f_scores(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """One-way F of each column from (classes,) counts and (classes, columns) sums and sums of squares; a class without rows is left out."""
    n, s, q = n[n > 0], s[n > 0], q[n > 0]
    between = (s * s / n[:, None]).sum(0) - s.sum(0) ** 2 / n.sum()
    within = q.sum(0) - (s * s / n[:, None]).sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num((between / (len(n) - 1)) / (within / (n.sum() - len(n))), nan=0.0) if len(n) > 1 else np.zeros(s.shape[1])


def best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """The k largest, ties to the smaller column number."""
    return np.lexsort((np.arange(len(scores)), -scores))[:k]


def selection_leak(df: DataFrame, key: str, label: str, noise: int = 500, k: int = 10, repeats: int = 20, folds: int = 5, ridge: float = 1.0,
                   seed: int = 42, steps: int = 25) -> DataFrame:
    """(selection, repeat, fold, accuracy): a 0/1 label predicted from pure noise, once with the ``k`` columns of the largest F score chosen on all
    rows, once with those chosen inside each training fold. ``noise`` columns are drawn anew for each repeat.

    Counts, sums and sums of squares of every column per (repeat, fold, class) come from one scan; a training fold is the total less one fold.
    The ``2 * repeats * folds`` logistic models (standardised columns, ``ridge`` / 2 on the weights but not the constant) share every scan of Newton's
    method: it sums gradient and curvature of all of them, and is over when no weight moves (``steps`` scans at most; fewer than ten are usual).
    Noise is computed from the row key where it is used, never stored. What reaches the driver are the sums: their number is set by
    the arguments, not by the table. Rows with a null label take no part; repeated keys have the same noise. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(key, F.col(label).cast("int").alias("y")).where("y is not null")
    parts = settle(stratified_folds(rows, key, "y", folds).select(F.xxhash64(key, F.lit(seed)).alias("h"), "y", "fold"), "noise-folds")

    def slices(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for lo in range(0, len(b), SLICE):
            c = b.iloc[lo:lo + SLICE]
            yield c["h"].to_numpy(np.int64), c["y"].to_numpy(np.int64), c["fold"].to_numpy(np.int64)

    def moments(b: pd.DataFrame):
        for h, y, fold in slices(b):
            group = np.zeros((2 * folds, len(h)))
            group[2 * fold + y, np.arange(len(h))] = 1.0
            for r in range(repeats):
                x = noise_columns(h, np.arange(r * noise, (r + 1) * noise))
                yield (r,), np.concatenate([group.sum(1)[:, None], group @ x, group @ (x * x)], axis=1).ravel()

    sums = {q["repeat"]: np.array(q["sums"]).reshape(folds, 2, 1 + 2 * noise) for q in vector_sums(parts, {"repeat": "int"}, moments).collect()}
    chosen, centre, scale, names = [], [], [], []
    for r in sorted(sums):
        whole = sums[r].sum(0)
        split = lambda m: (m[:, 0], m[:, 1:1 + noise], m[:, 1 + noise:])
        outside = best_columns(f_scores(*split(whole)), k)
        for i in range(folds):
            n, s, q = split(whole - sums[r][i])
            mean = s.sum(0) / max(n.sum(), 1)
            sd = np.sqrt(np.maximum(q.sum(0) / max(n.sum(), 1) - mean**2, 0))
            for how, cols in (("selected on all rows", outside), ("selected inside the fold", best_columns(f_scores(n, s, q), k))):
                names.append((how, r, i))
                chosen.append(cols)
                centre.append(mean[cols])
                scale.append(np.where(sd[cols] > 0, sd[cols], 1.0))
    schema = "selection string, repeat int, fold int, accuracy double"
    if not names:
        return spark.createDataFrame([], schema)
    wide = len(chosen[0]) + 1
    needed = [np.unique(np.concatenate([c for c, (_, q, _) in zip(chosen, names) if q == r])) for r in range(repeats)]
    fixed = spark.sparkContext.broadcast((names, chosen, centre, scale, needed))

    def designs(h: np.ndarray):
        """(model, its held fold, design matrix) for every model; the noise of a repeat is made once."""
        names, chosen, centre, scale, needed = fixed.value
        at, x = None, None
        for m, (_, r, i) in enumerate(names):
            if r != at:
                at, x = r, noise_columns(h, needed[r] + r * noise)
            z = (x[:, np.searchsorted(needed[r], chosen[m])] - centre[m]) / scale[m]
            yield m, i, np.column_stack([np.ones(len(h)), z])

    weights = np.zeros((len(names), wide))
    penalty = np.diag([0.0, *[ridge] * (wide - 1)])
    for _ in range(steps):
        now = spark.sparkContext.broadcast(weights.copy())

        def curvature(b: pd.DataFrame, now=now):
            for h, y, fold in slices(b):
                for m, i, x in designs(h):
                    x, t = x[fold != i], y[fold != i]
                    p = 1 / (1 + np.exp(-np.clip(x @ now.value[m], -500, 500)))
                    yield (m,), np.concatenate([x.T @ (t - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        move = 0.0
        for q in vector_sums(parts, {"model": "int"}, curvature).collect():
            m, v = q["model"], np.array(q["sums"])
            step = np.linalg.solve(v[wide:].reshape(wide, wide) + penalty + 1e-9 * np.eye(wide), v[:wide] - penalty @ weights[m])
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))  # a separable fold must not run away
            weights[m] += step
            move = max(move, np.abs(step).max())
        now.destroy()
        if move < 1e-6:
            break
    last = spark.sparkContext.broadcast(weights)

    def hits(b: pd.DataFrame):
        for h, y, fold in slices(b):
            for m, i, x in designs(h):
                yield (m,), np.array([(fold == i).sum(), (((x @ last.value[m]) > 0) == (y == 1))[fold == i].sum()], np.float64)

    model = spark.createDataFrame([(m, how, r, i) for m, (how, r, i) in enumerate(names)], "model int, selection string, repeat int, fold int")
    return vector_sums(parts, {"model": "int"}, hits).join(model, "model").select("selection", "repeat", "fold", F.try_divide(F.col("sums")[1], F.col("sums")[0]).alias("accuracy"))
