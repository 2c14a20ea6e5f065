"""Split and resampling queries."""
from pyspark.sql import functions as F

from tidegauge.operators import splits as P
from tidegauge.operators.joins import overlap_audit
from tidegauge.operators.vectors import euclid
from tidegauge.plans.common import LI_KEYS, LI_U, MONTHLY, h_sql, monthly, u_sql
from tidegauge.plans.registry import query, rnd, table

K4 = ", ".join(LI_KEYS)


@query("split_1", f"select {K4}, {LI_U} < 0.25 is_test from lineitem")
def split_1(spark, sf):
    return P.random_split(table(spark, sf, "lineitem"), LI_KEYS).select(*LI_KEYS, "is_test")


H = h_sql("doc_id")


@query("split_2", f"select doc_id, quality, row_number() over (partition by quality order by {H}, doc_id) <= floor(count(*) over (partition by quality)*0.25+0.5) is_test from labels")
def split_2(spark, sf):
    return P.stratified_split(table(spark, sf, "labels"), "doc_id", "quality").select("doc_id", "quality", "is_test")


@query("split_3", f"select doc_id, quality, ((row_number() over (partition by quality order by {H}, doc_id)-1)%5)::INT fold from labels")
def split_3(spark, sf):
    return P.stratified_folds(table(spark, sf, "labels"), "doc_id", "quality").select("doc_id", "quality", "fold")


@query("split_4", f"""with r as (select series, m, row_number() over (partition by series order by m) rn, count(*) over (partition by series) n from {MONTHLY})
 select series, strftime(m,'%Y-%m-%d') m, f::INT fold, case when rn <= n-(5-f)*12 then 'train' else 'test' end as role from r, range(5) t(f) where rn <= n-(5-f)*12+12""")
def split_4(spark, sf):
    return P.expanding_folds(monthly(table(spark, sf, "orders")), "series", "m").select("series", F.date_format("m", "yyyy-MM-dd").alias("m"), "fold", "role")


@query("split_5", """with d as (select event_id, event_type, epoch(ts-timestamp '2024-01-01')/86400*100/30 t from events)
 select case when t<=60 then 'train' when t<=80 then 'calibrate' else 'test' end split, event_type, count(*) n, min(event_id) first_id from d group by 1,2""")
def split_5(spark, sf):
    day = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(86400e6) * 100 / 30
    e = table(spark, sf, "events").withColumn("split", P.time_split(day, F.lit(60), F.lit(80)))
    return e.groupBy("split", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("split_6", f"""with a as (select series, y, row_number() over (partition by series order by m)-1 i, count(*) over (partition by series) n from {MONTHLY}),
 b as (select *, i >= n-floor(n*0.2+0.5) walk, row_number() over (partition by series order by {h_sql('series', 'i')}, i) <= floor(n*0.2+0.5) shuffled from a),
 s as (select 'walk' scheme, series, i, y, walk test from b union all select 'shuffled', series, i, y, shuffled from b),
 p as (select t.scheme, t.series, t.i, t.y, d.y dy, row_number() over (partition by t.scheme, t.series, t.i order by abs(t.i-d.i), d.i) k from s t join s d on t.scheme=d.scheme and t.series=d.series and t.test and not d.test),
 q as (select scheme, series, i, y, avg(dy) p from p where k<=5 group by 1,2,3,4)
 select scheme, series, round(sqrt(avg(pow(y-p,2))),3) rmse from q group by 1,2""")
def split_6(spark, sf):
    return P.nearest_in_time_gap(monthly(table(spark, sf, "orders")), "series", "m", "y").select("scheme", "series", rnd("rmse", 3).alias("rmse"))


SIZES = "(select min(n) lo, max(n) hi from (select toxic, count(*) n from labels group by 1))"


@query("split_7", f"select doc_id, toxic from labels, {SIZES} qualify row_number() over (partition by toxic order by {H}, doc_id) <= lo")
def split_7(spark, sf):
    return P.undersample(table(spark, sf, "labels"), "doc_id", "toxic").select("doc_id", "toxic")


OVER = f"""(with r as (select doc_id, toxic, row_number() over (partition by toxic order by {H}, doc_id) rk, count(*) over (partition by toxic) n from labels),
 i as (select toxic, n, unnest(range(1, (hi - n + 1)::BIGINT)) draw from (select distinct toxic, n from r), {SIZES}),
 d as (select toxic, floor({u_sql('toxic', 'draw')}*n)::BIGINT + 1 rk, count(*) more from i group by all)
 select doc_id, toxic, unnest(range(1, (2 + coalesce(more, 0))::BIGINT)) as copy from r left join d using (toxic, rk))"""


@query("split_8", f"select doc_id, toxic, copy from {OVER}")
def split_8(spark, sf):
    return P.oversample(table(spark, sf, "labels"), "doc_id", "toxic").select("doc_id", "toxic", "copy")


@query("split_9", f"""with r as (select event_id, row_number() over (order by event_id) rk, count(*) over () n from events), d as (select floor({u_sql('rk')}*n)::BIGINT+1 rk, count(*) copies from r group by 1)
 select event_id, copies from r join d using (rk)""")
def split_9(spark, sf):
    return P.bootstrap(table(spark, sf, "events").select("event_id"), "event_id").select("event_id", "copies")


@query("split_10", f"""with e as (select vec_id, label, embedding::DOUBLE[] v, row_number() over (partition by label order by {h_sql('vec_id')}, vec_id) rk, count(*) over (partition by label) n from embeddings), s as (select max(n) hi from e),
 t as (select vec_id, label, unnest(range(1, ((hi-n)//n + case when rk <= (hi-n)%n then 1 else 0 end + 1)::BIGINT)) as copy from e, s),
 d as (select a.vec_id, b.vec_id nb, row_number() over (partition by a.vec_id order by list_distance(a.v,b.v), b.vec_id) k from e a join e b on a.label=b.label and a.vec_id<>b.vec_id),
 p as (select t.*, floor({u_sql('vec_id', 'copy')}*5)+1 k from t)
 select p.vec_id, p.copy, p.label, nb neighbour, round({u_sql('p.vec_id', 'p.copy', seed=43)},6) gap, true between_parents from p join d on p.vec_id=d.vec_id and p.k=d.k""")
def split_10(spark, sf):
    e = table(spark, sf, "embeddings")
    s = P.smote(e, "vec_id", "label", "embedding")
    v = e.select("vec_id", F.col("embedding").alias("a"))
    j = s.join(v, "vec_id").join(v.withColumnsRenamed({"vec_id": "neighbour", "a": "b"}), "neighbour")
    # a convex combination: the two legs add up to the distance of the parents
    on_line = F.abs(euclid("a", "embedding") + euclid("embedding", "b") - euclid("a", "b")) < 1e-9
    return j.select("vec_id", "copy", "label", "neighbour", rnd("gap").alias("gap"), on_line.alias("between_parents"))


@query("split_11", f"""with b as (select bag, doc_id, toxic, row_number() over (partition by bag, toxic order by {h_sql('doc_id', 'bag')}, doc_id) rk from labels, range(25) t(bag)) select bag::INT bag, doc_id, toxic from b, {SIZES} where rk <= lo""")
def split_11(spark, sf):
    return P.balanced_bags(table(spark, sf, "labels"), "doc_id", "toxic", 25).select("bag", "doc_id", "toxic")


@query("split_12", f"""with e as (select *, {u_sql('doc_id', 'copy', seed=7)} < 0.25 t from {OVER}) select 'resample then split' as "order", count(*) leaked from e where t and doc_id in (select doc_id from e where not t)
 union all select 'split then resample', 0""")
def split_12(spark, sf):
    return P.resample_leak(table(spark, sf, "labels"), "doc_id", "toxic")


@query("split_13", f"""with d as (select doc_id, source, md5(text) h, {u_sql('doc_id', seed=5)} < 0.3 t from documents) select source, count(*) test_rows, count(*) filter (h in (select h from d where not t)) leaked from d where t group by 1""")
def split_13(spark, sf):
    d = P.random_split(table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("h")), ["doc_id"], 0.3, 5)
    leaked = overlap_audit(d.where("not is_test"), d.where("is_test"), ["h"]).groupBy("source").agg(F.count(F.lit(1)).alias("leaked"))
    rows = d.where("is_test").groupBy("source").agg(F.count(F.lit(1)).alias("test_rows"))
    return rows.join(leaked, "source", "left").na.fill(0, ["leaked"])
