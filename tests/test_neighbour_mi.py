"""Neighbour-based mutual information against all pairs of distances."""
import numpy as np
import pytest

from tidegauge.operators import neighbour_mi as N
from tidegauge.operators.neighbour_mi import digamma, neighbour_information


def brute(x, y, k=3):
    keep = np.isin(y, [c for c in np.unique(y) if (y == c).sum() > 1])
    x, y = x[keep], y[keep]
    d = np.abs(x[:, None] - x[None])
    total = 0.0
    for i in range(len(x)):
        own = np.sort(np.delete(d[i][y == y[i]], np.flatnonzero(np.flatnonzero(y == y[i]) == i)))
        use = min(k, len(own))
        r = own[use - 1]
        m = (d[i] == 0).sum() if r == 0 else (d[i] < r * (1 - 1e-7)).sum()
        total += digamma(use) - digamma(len(own) + 1) - digamma(m)
    return max(0.0, digamma(len(x)) + total / len(x))


def test_equals_all_pairs_with_ties(spark):
    r = np.random.default_rng(2)
    n = 2_000
    y = r.integers(0, 3, n)
    cols = {"shifted": np.round(y + r.normal(size=n), 2), "ring": np.round(np.where(y == 1, r.normal(size=n) * 3, r.normal(size=n) * 0.4), 3),
            "noise": r.normal(size=n), "coarse": r.integers(0, 6, n).astype(float)}
    y[0] = 9  # a class of one row
    y[1:3] = 8  # fewer others than k
    rows = [(i, int(y[i]), *(float(c[i]) for c in cols.values())) for i in range(n)] + [(n, None, 1.0, 1.0, 1.0, 1.0), (n + 1, 1, None, float("nan"), None, None)]
    d = spark.createDataFrame(rows, "id long, y int, shifted double, ring double, noise double, coarse double").repartition(5)
    got = {q["feature"]: q["mi"] for q in neighbour_information(d, ["id"], "y", list(cols)).collect()}
    assert got.keys() == cols.keys()
    for c, x in cols.items():
        assert got[c] == pytest.approx(brute(x, y), abs=1e-9), c
    assert got["ring"] > 0.15 and got["noise"] < 0.05
    assert neighbour_information(d.where("id < 0"), ["id"], "y", ["noise"]).count() == 0


def test_digamma_at_known_values():
    assert digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-12) and digamma(0.5) == pytest.approx(-1.9635100260214235, abs=1e-12)
    assert digamma(100) == pytest.approx(4.600161852738087, abs=1e-12)


def test_many_cells_and_what_is_written(spark, monkeypatch):
    """Intervals that end in other cells, classes spread thin over all cells, and steps no larger than the different (class, value) rows."""
    r = np.random.default_rng(5)
    n = 3_000
    y = np.where(r.random(n) < 0.02, r.integers(10, 14, n), r.integers(0, 2, n))
    y[:2] = [98, 98]
    cols = {"heavy": np.round(r.standard_cauchy(n), 2), "even": y + r.normal(size=n), "coarse": r.integers(0, 40, n).astype(float)}
    d = spark.createDataFrame([(i, f"c{y[i]}", *(float(c[i]) for c in cols.values())) for i in range(n)], "id long, y string, heavy double, even double, coarse double").repartition(3)
    written = []
    real = N.settle
    monkeypatch.setattr(N, "settle", lambda df, name: written.append((name, real(df, name))) or written[-1][1])
    monkeypatch.setattr(N, "BUCKET_ROWS", 40, raising=False)
    monkeypatch.setattr(N, "CELL", 3, raising=False)
    got = {q["feature"]: q["mi"] for q in neighbour_information(d, ["id"], "y", list(cols)).collect()}
    for c, x in cols.items():
        assert got[c] == pytest.approx(brute(x, y), abs=1e-9), c
    steps = {name: df.count() for name, df in written}
    different = sum(len({*zip(y.tolist(), x.tolist())}) for x in cols.values())
    assert max(steps.values()) <= 1.5 * different, steps
    assert 0 < steps["open"] < different
