"""Cell search: recall where the vectors have structure and where they have none, and the number of probed cells."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import search as IVF
from tidegauge.operators.vectors import top_k
from tidegauge.plans import txt
from tidegauge.session import scratch


@pytest.mark.parametrize("structured", [True, False])
def test_recall_of_all_queries(spark, structured):
    r = np.random.default_rng(6)
    x = r.normal(size=(900, 8))
    if structured:
        x = r.normal(size=(15, 8))[np.arange(900) % 15] * 4 + 0.3 * x
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    model, indexed = IVF.build_cells(d, "id", "v", None, scratch(spark, "cells"))
    assert len(model.clusterCenters()) == 30 and indexed.count() == 900
    n = IVF.probes_for(model, d.where("id % 9 = 0"), d, indexed, "id", "v", 5, 0.95, exclude_self=True)
    approx = IVF.probe(model, d, indexed, "id", "v", 5, n, exclude_self=True)
    recall = IVF.recall_against(top_k(d, d, "id", "v", 5, "cosine", exclude_self=True), approx, "id").agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    assert n < 15 if structured else n > 1  # few cells do where there are clusters


def test_cells_grow_with_the_corpus_up_to_the_bound():
    assert [IVF.cell_count(n, 64) for n in (0, 1, 100, 10**6)] == [1, 1, 10, 1_000]
    assert IVF.cell_count(10**12, 1_024) * 8 * 1_024 <= IVF.CENTRE_BYTES


def test_query_recall(spark, sf):
    out = txt.txt_3(spark, sf)
    assert out.agg(F.avg("recall")).first()[0] >= 0.9 and out.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
