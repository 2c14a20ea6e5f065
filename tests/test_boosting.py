"""Easy ensemble: stumps, weights and probabilities against AdaBoost row by row."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import boosting as B
from tidegauge.operators.splits import balanced_bags


def plain_adaboost(x, y, edges, rounds):
    """[(feature, cut value or None, left, right, vote)] and the last row weights."""
    w, stumps = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for f, cuts in enumerate(edges):
            for cut in cuts:
                low = x[:, f] < cut
                sides = [[w[m & (y == c)].sum() for c in (0, 1)] for m in (low, ~low)]
                if min(map(sum, sides)) <= 0:
                    continue
                gini = sum(2 * a * b / (a + b) for a, b in sides)
                if best is None or gini < best[0] - 1e-12 * w.sum():
                    best = gini, f, cut, [int(b > a) for a, b in sides]
        if best is None:
            break
        _, f, cut, sides = best
        h = np.where(x[:, f] < cut, *sides)
        error = w[h != y].sum() / w.sum()
        if error >= 0.5:
            break
        vote = np.log((1 - error) / error) if error > 0 else 1.0
        stumps.append((f, cut, *sides, vote))
        if error == 0:
            break
        w = w * np.exp(vote * (h != y))
    return stumps, w


def table(spark, n=400):
    r = np.random.default_rng(6)
    x = np.round(r.normal(size=(n, 3)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 + r.normal(size=n) * 0.7 > 1.6).astype(int)
    d = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    return d.repartition(5), x, y


def test_boosting_equals_row_by_row_adaboost(spark):
    d, x, y = table(spark)
    bags, rounds = 3, 7
    m = B.fit_boosted(d, "id", ["a", "b", "c"], "y", bags, rounds, 8)
    got = {q["id"]: q["prob"] for q in B.boosted_probability(d, m).collect()}
    want = np.zeros(len(x))
    for bag in range(bags):
        ids = [q["id"] for q in balanced_bags(d.select("id", "y"), "id", "y", bags).where(F.col("bag") == bag).collect()]
        stumps, w = plain_adaboost(x[ids], y[ids], m.edges, rounds)
        assert len(stumps) == rounds and m.total[bag] == pytest.approx(sum(s[4] for s in stumps))
        codes = np.stack([np.searchsorted(e, x[ids, f], side="right") for f, e in enumerate(m.edges)], 1)
        assert np.allclose(B.row_weights(m.votes[bag], m.total[bag], codes, y[ids]), w)
        margin = sum(v * (2 * np.where(x[:, f] < cut, a, b) - 1) for f, cut, a, b, v in stumps) / m.total[bag]
        want += 1 / (1 + np.exp(-2 * margin)) / bags
    assert np.allclose([got[i] for i in range(len(x))], want)


def test_weights_of_a_hand_case():
    # four rows, one feature: the first stump errs on one row of four, so that row's weight is multiplied by 3
    weight = np.zeros((1, 4, 2))
    for b, c in ((0, 0), (1, 0), (2, 1), (3, 0)):
        weight[0, b, c] = 1.0
    f, cut, left, right, error = B.best_stump(weight)
    assert (f, cut, left, right, error) == (0, 1, 0, 0, 0.25)  # the right side is a tie: class 0
    votes = np.zeros((1, 4))
    assert np.allclose(B.row_weights(votes, np.log(3), np.arange(4)[:, None], np.array([0, 0, 1, 0])), [1, 1, 3, 1])


def test_perfect_useless_and_missing_features(spark):
    d = spark.createDataFrame([(i, float(i % 2), 1.0, i % 2) for i in range(40)], "id long, good double, flat double, y int")
    m = B.fit_boosted(d, "id", ["good", "flat"], "y", 2, 5, 4)
    assert m.total.tolist() == [1.0, 1.0]  # no error: one stump, then the bag ends
    gaps = d.withColumn("good", F.when(F.col("y") == 1, F.col("good")))  # null and low values share the first bin
    assert {(q["y"], round(q["prob"], 6)) for q in B.boosted_probability(gaps, m).collect()} == {(0, 0.119203), (1, 0.880797)}
    none = B.fit_boosted(d, "id", ["flat"], "y", 2, 5, 4)
    assert {q["prob"] for q in B.boosted_probability(d, none).collect()} == {0.5}
    assert {q["prob"] for q in B.boosted_probability(d, B.fit_boosted(d.where("id < 0"), "id", ["good"], "y", 2, 3)).collect()} == {0.5}
