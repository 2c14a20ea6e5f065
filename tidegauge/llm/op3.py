"""Query: quality of every document, learned outside the held-out fold."""
from pyspark.sql import functions as F

from tidegauge.llm.catalog import query, table
from tidegauge.llm.labelled import remainder
from tidegauge.llm.quality_net import fit, scores


def quality_net(spark, sf_dir, docs=None):
    docs = table(spark, sf_dir, "documents", "doc_id", "text") if docs is None else docs
    return fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2), "quality")


@query("op3_quality")
def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = scores(docs, quality_net(spark, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
