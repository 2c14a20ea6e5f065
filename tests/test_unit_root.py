"""Unit-root test against plain least squares, one regression for each lag order."""
import math

import numpy as np
import pytest

from tidegauge.operators.moments import vector_sums
from tidegauge.operators.unit_root import augmented_dickey_fuller, most_lags, unit_root_p


def brute(y):
    d, top = np.diff(y), most_lags(len(y))

    def fit(q, start):
        rows = range(start + 1, len(y))
        x = np.array([[1.0, y[i - 1], *[d[i - 1 - k] for k in range(1, q + 1)]] for i in rows])
        target = np.array([d[i - 1] for i in rows])
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        ssr = ((target - x @ beta) ** 2).sum()
        return len(target) * math.log(ssr / len(target)) + 2 * (q + 2), ssr, x, beta

    q = min(range(top + 1), key=lambda k: (fit(k, top)[0], k))
    _, ssr, x, beta = fit(q, q)
    return len(x), q, beta[1] / math.sqrt(ssr / (len(x) - q - 2) * np.linalg.inv(x.T @ x)[1, 1])


def test_statistic_and_lags_equal_plain_regressions(spark):
    r = np.random.default_rng(8)
    walk, short = r.normal(size=300).cumsum() + 1e4, r.normal(size=25)
    season = 50 + np.sin(np.arange(120) * np.pi / 6) * 5 + r.normal(size=120)
    ar = np.zeros(200)
    for i in range(2, 200):
        ar[i] = 0.5 * ar[i - 1] - 0.4 * ar[i - 2] + r.normal()
    cases = {"walk": walk, "short": short, "season": season, "ar": ar, "four": np.array([1.0, 3.0, 2.0, 5.0])}
    rows = [(n, i, float(v)) for n, y in cases.items() for i, v in enumerate(y)]
    rows += [("flat", i, 2.0) for i in range(40)] + [("three", i, float(i)) for i in range(3)] + [("walk", 1_000, None)]
    d = spark.createDataFrame(rows, "name string, t int, y double").repartition(5)
    got = {q["name"]: q for q in augmented_dickey_fuller(d, "name", "t", "y").collect()}
    assert set(got) == set(cases) | {"flat", "three"} and got["flat"]["stat"] is None and got["three"]["stat"] is None
    for n in ("walk", "short", "season", "ar"):
        used, lags, stat = brute(cases[n])
        assert (got[n]["n"], got[n]["lags"]) == (used, lags) and got[n]["stat"] == pytest.approx(stat, rel=1e-7)
        assert got[n]["stationary"] == (got[n]["p"] < 0.05) and got[n]["p"] == unit_root_p(got[n]["stat"])
    assert max(got[n]["lags"] for n in ("ar", "season")) > 0


def test_rejection_rates(spark):
    """A true walk is called stationary about as often as the level says (order choice adds a little), a stationary series nearly always."""
    r = np.random.default_rng(1)
    noise = r.normal(size=(200, 150))
    rows = [(f"w{i}", t, float(v)) for i, e in enumerate(noise) for t, v in enumerate(e.cumsum())]
    rows += [(f"n{i}", t, float(v)) for i, e in enumerate(noise) for t, v in enumerate(e)]
    out = augmented_dickey_fuller(spark.createDataFrame(rows, "name string, t int, y double").repartition(6), "name", "t", "y").toPandas()
    share = out.groupby(out["name"].str[0])["stationary"].mean()
    assert 0.0 < share["w"] < 0.12 and share["n"] > 0.9


def test_tail_probability_at_published_critical_values():
    assert [round(unit_root_p(x), 2) for x in (-3.43, -2.86, -2.57)] == [0.01, 0.05, 0.1]
    assert unit_root_p(5) == 1 and unit_root_p(-30) == 0 and all(np.diff([unit_root_p(x) for x in np.linspace(-6, 2.5, 60)]) > 0)


def test_vector_sums_add_over_tasks(spark):
    d = spark.range(1_000).repartition(7)
    parts = lambda b: (((int(k),), np.array([len(g), g["id"].sum()])) for k, g in b.groupby(b["id"] % 3))
    got = {q["k"]: q["sums"] for q in vector_sums(d, {"k": "long"}, parts).collect()}
    assert got == {k: [len(range(k, 1_000, 3)), sum(range(k, 1_000, 3))] for k in range(3)}
