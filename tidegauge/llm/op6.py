"""Query: toxicity of every document, learned outside the held-out fold."""
from pyspark.sql import functions as F

from tidegauge.llm.catalog import query, table
from tidegauge.llm.labelled import remainder
from tidegauge.llm.toxic_spans import fit, passages


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0), "toxic")
    found = passages(docs, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
