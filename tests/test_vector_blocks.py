"""Searches move each vector once, whatever it meets: blocks against blocks, with duplicates, ties and rows that take no part."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import vectors as V
from tidegauge.operators.metric_tree import MetricIndex


def frame(spark, x, parts=6):
    return spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, g int, v array<double>").repartition(parts)


def test_vectors_without_structure_are_written_once(spark):
    """All cells must be visited; a query still lies in one block, with a bit for each cell."""
    n, width = 3_000, 48
    d = frame(spark, np.random.default_rng(1).normal(size=(n, width)))
    index = MetricIndex(d, "id", "v")
    first, later = index.plan(d, 5, True)
    assert index.pairs(d, 5, True) > n * n / 2
    for blocks in (first, later):
        assert blocks.agg(F.sum(F.octet_length("qmat"))).first()[0] == 8 * n * width
    assert index.blocks.agg(F.sum(F.octet_length("mat"))).first()[0] == 8 * n * width


def test_a_query_may_name_several_groups(spark):
    x = np.random.default_rng(4).normal(size=(300, 6))
    d = frame(spark, x)
    q = d.withColumn("g", F.array(F.col("g"), (F.col("g") + 1) % 3))
    got = {}
    for r in V.top_k(q, d, "id", "v", 4, "euclid", exclude_self=True, by="g").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for i in range(300):
        near = sorted((np.linalg.norm(x[i] - x[j]), j) for j in range(300) if j != i and j % 3 in (i % 3, (i + 1) % 3))
        assert got[i] == [j for _, j in near[:4]]


@pytest.mark.parametrize("by", [None, "g"])
def test_ties_copies_and_rows_without_vector(spark, by):
    x = np.random.default_rng(5).normal(size=(200, 4)).round(1)
    x[50:90] = x[20]
    d = frame(spark, x).withColumn("g", F.lit(1)).withColumn("v", F.when(F.col("id") != 3, F.col("v")))
    d = d.unionByName(d.where("id = 60").withColumn("id", F.lit(None).cast("long")))
    got = {}
    for r in V.top_k(d, d, "id", "v", 5, "cosine", exclude_self=True, by=by).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert set(got) == set(range(200)) - {3} and all(len(h) == 5 for h in got.values())
    assert got[20] == [50, 51, 52, 53, 54] and got[70] == [20, 50, 51, 52, 53]
