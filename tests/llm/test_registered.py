"""The registered queries against their SQL, and the pipeline against its stages' rules."""
import importlib
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_mod
import corpus_pipeline
from tidegauge.llm.catalog import load

QUERIES, SQL = load()
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_mod.queries()) and set(SQL) <= set(entry_mod.oracle_sql())


def rows(d):
    cols = sorted(d.columns)
    return cols, sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in d[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.sql(SQL[name]).df())


@pytest.mark.parametrize("name,label,fold,least", [("op3_quality", "quality", 4, 0.85), ("op6_toxicity", "toxic", 5, 0.85)])
def test_held_out_accuracy(spark, sf, name, label, fold, least):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got["score"].between(0, 1).all()
    known = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = known[known["held_out"]]
    assert len(held) and (held["predicted"] == held[label]).mean() >= least


def test_pipeline_stages_follow_their_rules(spark, sf):
    from tidegauge.llm.decontaminate import report
    from tidegauge.llm.nearjoin import near_links
    from tidegauge.session import settle

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, sf), "stage")
        if name != "best-fit packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        seen.append((docs, out))
        docs = out
    near_in, near_out = seen[1]
    want = {r["doc_id"] for r in near_links(near_in).where("doc_id = class_id").collect()}
    assert {r["doc_id"] for r in near_out.collect()} == want and near_links(near_out).where("n_links > 0").count() == 0
    sub_in, sub_out = seen[2]
    texts = {r["doc_id"]: r["text"] for r in sub_out.collect()}
    for r in sub_in.collect():
        if r["doc_id"] in texts:
            a, b = r["text"].split(), texts[r["doc_id"]].split()
            it = iter(a)
            assert all(x in it for x in b)  # what is left is a subsequence
    clean_in, clean_out = seen[3]
    bad = {r["doc_id"] for r in report(clean_in, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean_in.collect()} - bad == {r["doc_id"] for r in clean_out.collect()}
    packed = seen[4][1]
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean_out.collect()}


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(entry_mod.__file__)
    importlib.import_module("tidegauge.plans")
    for folder, _, names in os.walk(os.path.join(root, "tidegauge")):
        if not folder.endswith(os.sep + "llm"):
            for n in names:
                if n.endswith(".py"):
                    assert "tidegauge.llm" not in open(os.path.join(folder, n)).read()
