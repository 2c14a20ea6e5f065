"""Exact isotonic calibration, draws with replacement, and the rows completed with it, against plain Python."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import aggregates as A
from tidegauge.operators import metrics as MT
from tidegauge.operators import ml as M
from tidegauge.operators import splits as SP


def brute_isotonic(x, y):
    """Distinct scores and their fitted rates by pooling the first violation until there is none."""
    scores = np.unique(x)
    blocks = [[[s], y[x == s].sum(), (x == s).sum()] for s in scores]
    i = 0
    while i < len(blocks) - 1:
        a, b = blocks[i], blocks[i + 1]
        if a[1] * b[2] >= b[1] * a[2]:
            blocks[i:i + 2] = [[a[0] + b[0], a[1] + b[1], a[2] + b[2]]]
            i = max(i - 1, 0)
        else:
            i += 1
    return scores, np.concatenate([np.full(len(b[0]), b[1] / b[2]) for b in blocks])


@pytest.mark.parametrize("rows,distinct,parts", [(100_000, 3_000, 7), (2_000, 2_000, 2), (50, 4, 3), (1, 1, 1)])
def test_isotonic_fit_is_exact_at_any_partitioning(spark, rows, distinct, parts):
    r = np.random.default_rng(rows)
    x = np.round(r.integers(0, distinct, rows) / distinct, 6)
    y = (r.random(rows) < 0.2 + 0.6 * x**2).astype(float)
    cal = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (0.5, None), (float("nan"), 1.0)], "p double, y double").repartition(parts)
    ask = np.concatenate([r.random(300), x[:50], [-1.0, 2.0]])
    test = spark.createDataFrame([(i, float(v), "k") for i, v in enumerate(ask)] + [(-1, None, "n"), (-2, float("nan"), "n")], "id long, p double, _b string").repartition(parts)
    got = {q["id"]: q["calibrated"] for q in M.isotonic(cal, test, "p", "y").collect()}
    assert len(got) == len(ask) + 2 and got[-1] is None and got[-2] is None
    want = np.interp(ask, *brute_isotonic(x, y))
    assert np.allclose([got[i] for i in range(len(ask))], want, atol=1e-12)


def test_isotonic_without_a_calibration_slice_gives_null(spark):
    none = spark.createDataFrame([], "p double, y double")
    test = spark.createDataFrame([(1, 0.5)], "id long, p double")
    assert [q["calibrated"] for q in M.isotonic(none, test, "p", "y").collect()] == [None]


def test_stacks_merge_like_one_stack():
    r = np.random.default_rng(5)
    x = np.arange(500.0)
    s, w = r.integers(0, 4, 500).astype(float), np.full(500, 3.0)
    whole = M.pool_adjacent(x, x, s, w)
    parts = [M.pool_adjacent(*(v[i:i + 37] for v in (x, x, s, w))) for i in range(0, 500, 37)]
    merged = M.pool_adjacent(*(np.concatenate(v) for v in zip(*parts)))
    assert all((a == b).all() for a, b in zip(whole, merged)) and (np.diff(whole[2] / whole[3]) > 0).all()


def test_oversampling_draws_with_replacement(spark):
    d = spark.range(1_000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = SP.oversample(d, "id", "y")
    counts = {q["id"]: q["n"] for q in got.where("y = 1").groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got.groupBy("y").count().where("count <> 900").count() == 0 and len(counts) == 100
    assert got.where("y = 0").where("copy > 1").count() == 0
    extra = np.array(list(counts.values())) - 1
    assert extra.sum() == 800 and extra.min() <= 4 and extra.max() >= 13 and 4 < extra.var() < 14  # Poisson-like, not even


def test_resampling_to_a_size(spark):
    d = spark.range(300).withColumn("v", F.lit(1))
    got = SP.resample(d, "id", 5_000).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    assert tuple(got) == (5_000, 300) and SP.resample(d, "id", 0).count() == 0


def test_stage_lift_residuals_and_profile(spark):
    d = spark.createDataFrame([(1, 10.0, 8.0, 10.0, "a"), (2, 20.0, 24.0, 21.0, "a"), (3, 5.0, 5.0, 5.0, "b")], "k long, y double, b double, p double, g string")
    lift = {q["g"]: (q["rmse_before"], q["rmse"], q["lift"]) for q in MT.stage_lift(d, "y", "b", "p", ["g"]).collect()}
    before, after = np.sqrt(10), np.sqrt(0.5)
    assert lift["a"] == pytest.approx((before, after, 1 - after / before)) and lift["b"] == (0, 0, None)
    assert sorted(map(tuple, MT.residual_table(d, ["k"], "y", "p").collect())) == [(1, 10.0, 10.0, 0.0), (2, 21.0, 20.0, -1.0), (3, 5.0, 5.0, 0.0)]
    prof = {q["column"]: (q["dtype"], q["n_rows"], q["n_columns"]) for q in A.numeric_profile(d, ["k", "y"]).collect()}
    assert prof == {"k": ("bigint", 3, 5), "y": ("double", 3, 5)}
