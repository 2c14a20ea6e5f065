"""Query: words of every document inside occurrences of benchmark windows."""
from pyspark.sql import functions as F

from tidegauge.llm.catalog import query, table
from tidegauge.llm.decontaminate import report

_WORDS = r"regexp_extract_all(lower_az(coalesce(text,'')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace(
    "lower_az(coalesce(text,''))", "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')")

SQL = rf"""
with d as (select doc_id, {_WORDS} w from documents),
b as (select item_id, {_WORDS} w from benchmark),
bw as (select distinct item_id, least(13, len(w)) n, array_to_string(w[i:i+least(13,len(w))-1], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w)-12, 1)+1)) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') g from
  (select doc_id, w, n, unnest(range(1, len(w)-n+2)) i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, dw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i+n)) p from hits) group by 1),
named as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct doc_id, item_id::varchar s from hits) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
 sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join covered using (doc_id) left join named using (doc_id)
"""


@query("op9_decontaminate", SQL)
def op9_decontaminate(spark, sf_dir):
    found = report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    named = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
