"""Query: licence lines of every document."""
from pyspark.sql import functions as F

from tidegauge.llm.catalog import query, table
from tidegauge.llm.licences import LEAST, TEMPLATES, scan_licences

_NAMED = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with l as (select doc_id, i - 1 line, {_WORDS.format("ls[i]")} w from (select doc_id, ls, unnest(range(1, len(ls)+1)) i from
  (select doc_id, string_split(text, chr(10)) ls from documents where text is not null))),
t as (select licence, {_WORDS.format("body")} w from (values {_NAMED}) v(licence, body)),
lg as (select doc_id, line, g, count(*) c from (select doc_id, line, unnest([w[j] || ' ' || w[j+1] for j in range(1, len(w))]) g from l) group by all),
tg as (select licence, g, count(*) c from (select licence, unnest([w[j] || ' ' || w[j+1] for j in range(1, len(w))]) g from t) group by all),
ls as (select doc_id, line, sum(c) n from lg group by all), ts as (select licence, sum(c) n from tg group by all),
m as (select doc_id, line, licence, sum(least(lg.c, tg.c)) s from lg join tg using (g) group by all),
r as (select doc_id, line, licence, 2 * s / (ls.n + ts.n)::DOUBLE dice from m join ls using (doc_id, line) join ts using (licence)),
b as (select doc_id, line, arg_max(licence, (dice, -rank)) licence, max(dice) dice from (select *, dense_rank() over (order by licence) rank from r where dice >= {LEAST}::DOUBLE) group by all)
select d.doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end::bigint n_lines, count(b.line)::bigint n_licence_lines,
 string_agg(distinct b.licence, ',' order by b.licence) licences, coalesce(round(max(dice), 6), 0)::double best_dice
from documents d left join b on d.doc_id = b.doc_id group by d.doc_id, text
"""


@query("op5_license_scan", SQL)
def op5_license_scan(spark, sf_dir):
    found = scan_licences(table(spark, sf_dir, "documents", "doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return found.select("doc_id", "n_lines", F.size("matches").cast("long").alias("n_licence_lines"),
                        F.when(F.size("matches") > 0, F.array_join(names, ",")).alias("licences"),
                        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)), 6).alias("best_dice"))
