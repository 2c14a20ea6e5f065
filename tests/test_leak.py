"""The selection-leak test against the same work on one matrix in numpy."""
import numpy as np
import pytest

from tidegauge.operators.leak import best_columns, f_scores, noise_columns, selection_leak
from tidegauge.operators.splits import stratified_folds


def labelled(spark, n=240):
    y = np.random.default_rng(4).random(n) < 0.4
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(n, None)], "id long, y int").repartition(5)


def plain_f(x, y):
    groups = [x[y == c] for c in (0, 1)]
    between = sum(len(g) * (g.mean(0) - x.mean(0)) ** 2 for g in groups)
    return between / (sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / (len(x) - 2))


def fit(x, y, ridge=1.0):
    x = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-12), x.T @ (y - p) - pen * w)
    return w


def test_every_fold_equals_the_plain_computation(spark):
    from pyspark.sql import functions as F

    d, noise, k, repeats, folds = labelled(spark), 30, 4, 2, 3
    got = {(q["selection"], q["repeat"], q["fold"]): q["accuracy"] for q in selection_leak(d, "id", "y", noise, k, repeats, folds).collect()}
    p = stratified_folds(d.where("y is not null"), "id", "y", folds).select(F.xxhash64("id", F.lit(42)).alias("h"), "y", "fold").toPandas()
    y, fold, want = p["y"].to_numpy(), p["fold"].to_numpy(), {}
    for r in range(repeats):
        x = noise_columns(p["h"].to_numpy(), np.arange(r * noise, (r + 1) * noise))
        for i in range(folds):
            train = fold != i
            for how, rows in (("selected on all rows", np.ones(len(y), bool)), ("selected inside the fold", train)):
                cols = best_columns(plain_f(x[rows], y[rows]), k)
                z = (x[:, cols] - x[train][:, cols].mean(0)) / x[train][:, cols].std(0)
                w = fit(z[train], y[train])
                want[how, r, i] = ((w[0] + z[~train] @ w[1:] > 0) == (y[~train] == 1)).mean()
    assert got.keys() == want.keys() and all(got[m] == pytest.approx(want[m]) for m in want)


def test_leaked_selection_looks_better_than_honest_selection(spark):
    got = selection_leak(labelled(spark), "id", "y", 200, 10, 6, 4).toPandas().groupby("selection")["accuracy"].mean()
    assert got["selected on all rows"] > got["selected inside the fold"] + 0.05


def test_noise_is_standard_normal_and_scores_are_exact(spark):
    x = noise_columns(np.random.default_rng(0).integers(-2**63, 2**63 - 1, 4_000), np.arange(40))
    assert np.abs(x.mean(0)).max() < 0.08 and np.abs(x.std(0) - 1).max() < 0.06 and np.abs(np.corrcoef(x.T) - np.eye(40)).max() < 0.08
    y = np.arange(4_000) % 3 == 0
    n = np.array([(~y).sum(), y.sum()])
    s, q = (np.array([v[~y].sum(0), v[y].sum(0)]) for v in (x, x * x))
    assert np.allclose(f_scores(n, s, q), plain_f(x, y.astype(int)))
    assert selection_leak(labelled(spark).where("id < 0"), "id", "y", 5, 2, 1, 2).count() == 0
