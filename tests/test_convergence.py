"""Convergence report against its plain definition: ranks by sorting, autocovariances by direct sums."""
import math
from statistics import NormalDist

import numpy as np
import pytest

from tidegauge.operators.convergence import convergence


def scores(x):
    flat = np.sort(x.ravel())
    rank = (np.searchsorted(flat, x, "left") + np.searchsorted(flat, x, "right") + 1) / 2
    return np.vectorize(NormalDist().inv_cdf)((rank - 0.375) / (x.size + 0.25))


def spread(halves):
    n = np.mean([len(h) for h in halves])
    w = np.mean([np.var(h, ddof=1) for h in halves])
    return w, (n - 1) / n * w + np.var([h.mean() for h in halves], ddof=1)


def ess(halves):
    w, plus = spread(halves)
    total = sum(len(h) for h in halves)
    if w == 0:
        return float(total)
    rho = []
    for t in range(min(len(h) for h in halves) - 2):
        rho.append(1 - (w - np.mean([((h - h.mean())[t:] * (h - h.mean())[:len(h) - t]).sum() / len(h) for h in halves])) / plus)
    s, low = 0.0, math.inf
    for m in range(len(rho) // 2):
        pair = rho[2 * m] + rho[2 * m + 1]
        if pair <= 0:
            break
        low = min(low, pair)
        s += low
    return total / max(2 * s - 1, 1 / math.log10(total))


def brute(chains):
    halves = [np.array(h) for c in chains for h in (c[:len(c) // 2], c[len(c) - len(c) // 2:])]
    cuts = np.cumsum([len(h) for h in halves])[:-1]
    x = np.concatenate(halves)
    bulk, folded = np.split(scores(x), cuts), np.split(scores(np.abs(x - np.median(x))), cuts)
    tail = [ess([(h <= np.quantile(x, q)).astype(float) for h in halves]) for q in (0.05, 0.95)]
    rhat = max(math.sqrt(plus / w) for w, plus in (spread(bulk), spread(folded)))
    whole = np.sort(np.concatenate(chains))
    k = math.floor(len(whole) * 0.94)
    at = int((whole[k:] - whole[:-k]).argmin())
    return {"draws": len(whole), "mean": whole.mean(), "sd": whole.std(ddof=1), "hdi_low": whole[at], "hdi_high": whole[at + k],
            "mcse_mean": whole.std(ddof=1) / math.sqrt(ess(halves)), "ess_bulk": ess(bulk), "ess_tail": min(tail), "rhat": rhat}


def ar(r, n, phi, start=0.0):
    out = [start]
    for _ in range(n - 1):
        out.append(phi * out[-1] + r.normal())
    return np.array(out)


def frame(spark, cases):
    rows = [(name, c, i, float(v)) for name, chains in cases.items() for c, chain in enumerate(chains) for i, v in enumerate(chain)]
    return spark.createDataFrame([*rows, ("iid", 0, 10**6, None), ("iid", 1, 10**6, float("nan"))], "name string, chain int, i long, v double").repartition(6)


def test_equals_definition_for_any_block(spark):
    r = np.random.default_rng(3)
    cases = {"iid": [r.normal(size=101) for _ in range(4)], "slow": [ar(r, 160, 0.9) for _ in range(3)], "stuck": [ar(r, 90, 0.99, 30.0 * c) for c in range(2)],
             "ties": [r.integers(0, 4, size=80) for _ in range(2)], "uneven": [r.normal(size=n) for n in (60, 95, 41)], None: [r.normal(size=40) for _ in range(2)]}
    for block in (8, 512):
        got = {q["name"]: q for q in convergence(frame(spark, cases), "name", "chain", "i", "v", block=block).collect()}
        assert set(got) == set(cases)
        for name, chains in cases.items():
            want = brute(chains)
            assert {k: got[name][k] for k in want} == pytest.approx(want, rel=1e-7), (name, block)
    assert got["stuck"]["rhat"] > 1.5 and got["iid"]["rhat"] < 1.05


def test_known_sizes(spark):
    """Independent draws count about once each; an AR(1) with slope f counts (1 - f) / (1 + f) as much."""
    r = np.random.default_rng(5)
    got = {q["name"]: q for q in convergence(frame(spark, {"iid": [r.normal(size=2_000) for _ in range(4)], "half": [ar(r, 2_000, 0.5) for _ in range(4)]}), "name", "chain", "i", "v").collect()}
    assert got["iid"]["ess_bulk"] == pytest.approx(8_000, rel=0.15) and got["half"]["ess_bulk"] == pytest.approx(8_000 / 3, rel=0.2)


def test_short_constant_and_empty(spark):
    d = frame(spark, {"iid": [], "flat": [[2.0] * 12] * 2, "short": [[1.0, 2.0, 4.0]] * 2})
    got = {q["name"]: q for q in convergence(d, "name", "chain", "i", "v").collect()}
    assert set(got) == {"flat", "short"} and got["flat"]["rhat"] is None and got["flat"]["ess_bulk"] == 24.0
    assert got["short"]["ess_bulk"] is None and got["short"]["draws"] == 6
    assert convergence(d.limit(0), "name", "chain", "i", "v").collect() == []
