"""Query: classes and link counts of documents by the similarity of their five-word shingles."""
from tidegauge.llm.catalog import query, table
from tidegauge.llm.nearjoin import near_links

SQL = r"""
with recursive d as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w from documents where text is not null),
t as (select min(doc_id) text_id, any_value(w) w from d group by text),
s as (select distinct text_id, array_to_string(w[i:i+least(5, len(w))-1], ' ') g from
  (select text_id, w, unnest(range(1, greatest(len(w)-4, 1)+1)) i from t where len(w) > 0)),
n as (select text_id, count(*) n from s group by 1),
p as (select a.text_id a, b.text_id b, count(*) c from s a join s b on a.g = b.g and a.text_id <> b.text_id group by 1, 2),
e as (select a, b from p join n x on x.text_id = a join n y on y.text_id = b where c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9),
walk(v, r) as (select text_id, text_id from t union select e.b, walk.r from walk join e on e.a = walk.v),
k as (select v text_id, min(r) class_id from walk group by 1),
l as (select a text_id, count(*) n_links from e group by 1)
select d.doc_id, t2.text_id, class_id, coalesce(n_links, 0)::bigint n_links
from d join (select text, min(doc_id) text_id from d group by 1) t2 using (text) join k using (text_id) left join l using (text_id)
union all select doc_id, doc_id, doc_id, 0 from documents where text is null
"""


@query("op7_ngram_jaccard", SQL)
def op7_ngram_jaccard(spark, sf_dir):
    return near_links(table(spark, sf_dir, "documents", "doc_id", "text"))
