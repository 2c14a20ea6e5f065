"""Query: SimHash fingerprints of every document and the components of those that differ in three bits at most."""
from pyspark.sql import functions as F

from tidegauge.llm.catalog import query, table
from tidegauge.llm.popcount_join import simhash_components


@query("op11_simhash")
def op11_simhash(spark, sf_dir):
    found = simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
