"""No row is lost and no text ends a job: shared and null ids, vectors of two dimensions, long runs of blanks."""
import random
from collections import Counter

import numpy as np
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from tidegauge.llm import bestfit, decontaminate, nearjoin, projected_search


def test_every_dimension_is_searched(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=3).tolist()) for i in range(60)] + [(100 + i, r.normal(size=2).tolist()) for i in range(50)] + [(500, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in projected_search.nearest(df.where(F.col("vec_id") % 50 == 0), df).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    by = dict(rows)
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    for q in (0, 50, 100):
        near = sorted((-cos(by[q], v), i) for i, v in rows if i != q and len(v) == len(by[q]))[:5]
        assert sorted(got[q]) == [(k + 1, i) for k, (_, i) in enumerate(near)]
    assert set(got) == {0, 50, 100}


def test_near_duplicates_keep_different_texts_of_one_id(spark, prose):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "y"), (2, a + " more", "z"), (None, c, "n"), (None, c, "m"), (None, prose(60, 4), None), (3, c, "k"), (4, None, "q"), (4, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = Counter((x["doc_id"], x["text"]) for x in nearjoin.keep_one(docs).collect())
    assert kept == Counter([(1, a), (1, b), (3, c), (None, c), (None, c), (None, prose(60, 4)), (4, None), (4, None)])
    assert nearjoin.keep_one(docs).columns == docs.columns and nearjoin.keep_one(docs.where("doc_id > 9")).collect() == []


def test_contaminated_rows_go_by_row(spark, prose):
    bad, clean = prose(40, 5), prose(40, 6)
    docs = spark.createDataFrame([(1, bad, 1), (1, clean, 2), (None, bad, 3), (None, clean, 4), (2, None, 5), (3, "", 6)], "doc_id long, text string, at int")
    items = spark.createDataFrame([(7, bad)], "item_id long, text string")
    assert sorted(x["at"] for x in decontaminate.decontaminate(docs, items).collect()) == [2, 4, 5, 6]
    assert decontaminate.decontaminate(docs.where("at > 9"), items).collect() == []


def test_long_runs_of_blanks_have_the_ids_of_the_json(spark):
    plain = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    vocabulary = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(1)
    texts = [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" + "\t \n" * 300_000 + " b<|endoftext|>c", "".join(r.choice("ab .\n") for _ in range(5_000))]
    for t in texts:
        assert list(bestfit.token_ids(t, vocabulary, True)) == plain.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total = bestfit.tokenised(docs, added=True).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {x["doc_id"]: x["n"] for x in total} == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
