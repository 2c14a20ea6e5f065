"""Bounded training samples of labelled texts, and the folds of the classifiers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import settle


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % n


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(d, text, y): at most ``rows`` labelled documents, the ones whose ids hash lowest, settled.

    Only the id and the label are taken from ``labels`` (already cut to the training folds); ids without a document, null labels and null
    texts drop out. The sample's ids are the only thing that is broadcast: at most ``rows`` of them.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("d"), F.col(label).cast("double").alias("y")).where("d is not null and y is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).where("text is not null")
    ids = ids.join(texts.select("d"), "d", "left_semi")  # before the bound, so that absent documents use up none of it
    ids = ids.groupBy("d").agg(F.max("y").alias("y")).orderBy(F.xxhash64("d"), "d").limit(rows)
    return settle(texts.join(F.broadcast(ids), "d"), f"train-{label}")
