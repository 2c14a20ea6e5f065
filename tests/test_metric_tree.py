"""Search through the metric tree against all pairs, and how many pairs it compares."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import vectors as V
from tidegauge.operators.metric_tree import MetricIndex, Tree, distances


def clustered(n=4_000, width=16, centres=40, seed=3):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, width)) * 4
    x = c[r.integers(0, centres, n)] + r.normal(size=(n, width)) * 0.3
    x[100:140] = x[0]  # copies: ties go to the smaller key
    x[7] = x[11] = 0.0
    return np.round(x, 3)


def brute(q, c, k, metric, exclude_self):
    if metric == "cosine":
        unit = lambda m: m / np.where((m * m).sum(1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
        s = unit(q) @ unit(c).T
    else:
        s = -np.sqrt(((q[:, None] - c[None]) ** 2).sum(-1))
    s = np.round(s, 9)
    if exclude_self:
        np.fill_diagonal(s, -np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(c)), s.shape), -s), axis=1)[:, :k]
    return {i: [(int(j), round(float(s[i, j]), 6)) for j in row if s[i, j] > -np.inf] for i, row in enumerate(order)}


def frame(spark, x, parts=6):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(parts)


def found(rows):
    out = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


@pytest.mark.parametrize("metric,exclude_self", [("cosine", True), ("cosine", False), ("euclid", True)])
def test_tree_search_equals_all_pairs(spark, metric, exclude_self):
    x = clustered(1_500)
    d = frame(spark, x)
    got, want = found(V.top_k(d, d, "id", "v", 5, metric, exclude_self)), brute(x, x, 5, metric, exclude_self)
    assert set(got) == set(want)
    for i, hits in want.items():
        assert np.allclose([s for _, s in got[i]], [s for _, s in hits], atol=1e-5)
        scores = [s for _, s in hits]
        if min(abs(np.diff(scores)), default=1) > 1e-7:  # else rounding may order near ties either way
            assert [j for j, _ in got[i]] == [j for j, _ in hits]


def test_clustered_vectors_need_few_pairs(spark):
    x = clustered()
    d = frame(spark, x)
    assert MetricIndex(d, "id", "v").pairs(d, 5, True) < len(x) ** 2 / 4
    assert MetricIndex(d, "id", "v", "euclid").pairs(d, 5, True) < len(x) ** 2 / 4


def test_small_and_empty_corpora(spark):
    x = clustered(12)
    d = frame(spark, x, 2)
    assert found(V.top_k(d, d.where("id < 3"), "id", "v", 5)).keys() == set(range(12))
    assert all(len(h) == 3 for h in found(V.top_k(d, d.where("id < 3"), "id", "v", 5)).values())  # fewer than k: all
    assert V.top_k(d, d.where("id < 0"), "id", "v", 5).count() == 0 and V.top_k(d.where("id < 0"), d, "id", "v", 5).count() == 0
    gaps = d.withColumn("v", F.when(F.col("id") != 4, F.col("v")))
    assert set(found(V.top_k(gaps, gaps, "id", "v", 2))) == set(range(12)) - {4}
    same = d.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    assert {tuple(j for j, _ in h) for h in found(V.top_k(same, same, "id", "v", 3)).values()} == {(0, 1, 2)}


def test_bounds_cover_every_row():
    x = clustered(2_000)
    t = Tree(x[::50])
    cell, d, high = t.place(x)
    for c, r, h in zip(cell, d, high):
        t.count[c] += 1
        t.radius[c], t.reach[t.above[c]] = max(t.radius[c], r), max(t.reach[t.above[c]], h)
    limit = np.sort(distances(x[:200], x), axis=1)[:, 4]
    seen = np.zeros((200, len(t.leaf)), bool)
    for c, rows in t.visits(x[:200], limit):
        seen[rows, c] = True
    near = distances(x[:200], x) <= limit[:, None]
    assert all(seen[q, cell[j]] for q, j in zip(*np.nonzero(near))) and seen.mean() < 0.5
