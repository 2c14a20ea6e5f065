"""Query: documents without the passages of 13 words and more that a document with a smaller id holds."""
from pyspark.sql import functions as F

from tidegauge.llm.catalog import query, table
from tidegauge.llm.substrings import remove_repeats

WORD = r"[^\x20\x09-\x0D]+"

SQL = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
g as (select doc_id, i, md5(array_to_string(w[i:i+12], ' ')) h from (select doc_id, w, unnest(range(1, len(w)-11)) i from d where len(w) >= 13)),
firsts as (select h, min(doc_id) a from g group by 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i+13)) p from g join firsts using (h) where a < doc_id)),
words as (select doc_id, p, w[p] v from (select doc_id, w, unnest(range(1, len(w)+1)) p from d)),
kept as (select doc_id, string_agg(v, ' ' order by p) k, count(*) n from words anti join gone using (doc_id, p) group by 1)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(k, '')) kept_sha256 from d left join kept using (doc_id)
"""


@query("op10_substring_dedup", SQL)
def op10_substring_dedup(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
