"""Query: all documents packed into sequences of 1024 tokens."""
from tidegauge.llm.bestfit import pack_documents
from tidegauge.llm.catalog import query, table


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), added=True).drop("copy")
