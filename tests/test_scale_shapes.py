"""Shapes of plans that must hold at any size: what is copied per repeat, threshold, cell or pair of words stays off the network and out of the driver."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import digests
from tidegauge.functions.hashing import digest, key_prefix, poisson1, poisson1_edges, poisson1_of, unit_hash
from tidegauge.operators import detection as D
from tidegauge.operators import metrics as M
from tidegauge.operators import stats as S
from tidegauge.plans import fns


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_permutation_donors_are_not_broadcast(spark):
    d = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("y"))
    out = M.permutation_importance(d, "id", ["a"], "y", lambda c: c["a"] * 0.5, 3)
    assert "BroadcastHashJoin" not in physical(out) and out.count() == 3


def test_boxes_of_small_images_are_not_copied_to_cells(spark):
    box = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") + 40.0).alias("x2"), F.lit(40.0).alias("y2"))
    b = spark.range(30).select((F.col("id") % 10).alias("image"), "id", box.alias("box"), F.lit(0.5).alias("score"))
    few, cells = D.overlapping(b, b, ["image"], 20.0), D.overlapping(b, b, ["image"], 20.0, crowd=0)
    assert "Generate" not in physical(few) and "Generate" in physical(cells)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, cells.select(*few.columns).collect())) and few.count() == 90


def test_weights_from_digits_are_those_from_numbers(spark):
    d = spark.range(3_000).withColumn("null", F.lit(None).cast("long"))
    for keys in (["id"], ["null", "id"], ["null"]):
        h = d.withColumn("h", digest(key_prefix(*keys), F.col("id"))).select(poisson1_of(F.col("h")).alias("a"), poisson1(unit_hash(*keys, "id")).alias("b"))
        assert h.where("a <> b").count() == 0 and h.agg(F.max("a")).first()[0] >= 4


def test_word_pairs_are_counted_without_moving_them(spark, sf):
    plan = physical(fns.fn_6(spark, sf))
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc_id" in plan


def test_bootstrap_weights_in_numpy_are_those_of_the_digests(spark):
    """Keys of every length (none, empty, longer than a block of md5), gaps in the columns; no row is copied for a replicate."""
    key = F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.repeat(F.lit("é"), (F.col("id") % 70).cast("int")), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).otherwise("")))
    d = spark.range(400).select(key.alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("j"), (F.col("id") % 13).alias("a"),
                                F.when(F.col("id") % 9 > 0, F.sin("id")).alias("b"), F.when(F.col("id") % 17 > 0, F.cos("id") * 50).alias("y")).repartition(3)
    out = S.bootstrap_coefficients(d, ["k", "j"], ["a", "b"], "y", 12)
    assert "Generate" not in physical(out)
    z = S.standardise(d, ["a", "b"]).withColumn("one", F.lit(1.0)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(12))))
    w = poisson1_of(digest(key_prefix("k", "j"), F.col("rep"))).cast("double")
    m = S.cross_products(z, ["one", "a_z", "b_z", "y"], ["rep"], w)
    beta = lambda x: [("a", float(b[1])), ("b", float(b[2]))] if (b := np.linalg.solve(x[:3, :3], x[:3, 3])) is not None else None
    want = {(r[0], r[1]): r[2] for r in S.solve_rows(m, 4, ["rep"], "rep int, feature string, coef double", beta).collect()}
    got = {(r[0], r[1]): r[2] for r in out.collect()}
    assert got == pytest.approx(want, rel=1e-9) and len(got) == 24
    assert S.bootstrap_coefficients(d.limit(0), ["k", "j"], ["a", "b"], "y", 12).collect() == []


def test_first_numbers_and_counts():
    r = np.random.default_rng(1)
    for size in (0, 1, 3, 4, 26, 51, 55, 56, 63, 64, 65, 119, 128):
        heads, endings = r.integers(0, 256, (5, size), dtype=np.uint8), [b"1|42", b"300|42", b"", b"x" * 70]
        want = [[int.from_bytes(hashlib.md5(h.tobytes() + e).digest()[:4], "little") for h in heads] for e in endings]
        assert [x.tolist() for x in digests.first_numbers(heads, endings)] == want
    edges = poisson1_edges()
    x = np.array([*r.integers(0, 2**32, 5_000), *[e + d for e in edges for d in (-1, 0, 1)]], np.int64)
    assert digests.counts(x.astype(np.uint32).byteswap(), digests.counted(edges)).tolist() == np.searchsorted(edges, x, "right").tolist()
