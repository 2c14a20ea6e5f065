"""Query: the best collocations of each language."""
from tidegauge.llm.catalog import query, table
from tidegauge.llm.phrases import collocations, top

LEAST, BEST = 100, 2000
SQL = rf"""
with p as (select doc_id, coalesce(lang, 'und') lang, row_number() over () d, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') ps from documents where text is not null),
w as (select lang, regexp_extract_all(ps[i], '[^\x20\x09]+') w from (select lang, ps, unnest(range(1, len(ps)+1)) i from p)),
n as (select lang, sum(len(w))::hugeint n from w group by 1),
f as (select lang, m, array_to_string(w[i:i+m-1], ' ') phrase, w[i:i+m-1] ws, count(*)::hugeint f from (select lang, w, m, unnest(range(1, len(w)-m+2)) i from w, (select unnest(range(1, 6)) m) where len(w) >= m) group by all),
c as (select f.lang, m, ws, phrase, f a, n.n from f join n using (lang) where f >= {LEAST} and m > 1),
k as (select c.lang, c.phrase, c.ws, c.m, c.a, c.n, h.f l, t.f r, cut, (1000 * c.a * c.n) // (h.f * t.f) score from (select *, unnest(range(1, m)) cut from c) c
  join f h on h.lang = c.lang and h.m = cut and h.phrase = array_to_string(c.ws[1:cut], ' ') join f t on t.lang = c.lang and t.m = c.m - cut and t.phrase = array_to_string(c.ws[cut+1:], ' ')),
s as (select * from k qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
gone as (select distinct x.lang, x.phrase from s x join (select lang, m, a, unnest(flatten([[array_to_string(ws[i:j], ' ') for j in range(i, m+1)] for i in range(1, m+1)])) part, phrase from s) y
  on x.lang = y.lang and x.phrase = y.part and x.m < y.m and 100 * y.a >= 100 * x.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from s anti join gone using (lang, phrase) qualify rank <= {BEST}
"""


@query("op13_collocations", SQL)
def op13_collocations(spark, sf_dir):
    found = collocations(table(spark, sf_dir, "documents", "lang", "text"), LEAST)
    return top(found, BEST).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
