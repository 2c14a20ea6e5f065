"""Training-data pipeline over ``documents``: quality, near duplicates, repeated passages, benchmark passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the
shared folder and reads back as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bestfit import pack_documents
from tidegauge.llm.catalog import table
from tidegauge.llm.decontaminate import decontaminate
from tidegauge.llm.nearjoin import keep_one
from tidegauge.llm.op3 import quality_net
from tidegauge.llm.quality_net import keep_good
from tidegauge.llm.substrings import remove_repeats
from tidegauge.session import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects (score below 0.7) go. It learns from the labelled rows of ``docs`` outside the held-out fold."""
    return keep_good(docs, quality_net(spark, sf_dir, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8) the document with the smallest doc_id stays."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that a document with a smaller doc_id holds are cut; n_chars follows the text.
    No document goes: one of which no word is left stays with an empty text."""
    cut = remove_repeats(docs)
    text = F.when((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words")), "").otherwise(F.col("text"))  # nor its blanks
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars").cast("long"))}
    return cut.select(*[changed.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: at least one word in twenty lies inside benchmark windows."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as sequences of at most 1024 tokens; one row per piece."""
    return pack_documents(docs.select("doc_id", "text"), added=True).drop("copy")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packing),
]
#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
