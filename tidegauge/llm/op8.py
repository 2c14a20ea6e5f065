"""Query: the five nearest vectors of every fiftieth vector."""
from pyspark.sql import functions as F

from tidegauge.llm.catalog import query, table
from tidegauge.llm.projected_search import nearest


@query("op8_nearest_vectors")
def op8_nearest_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors)
