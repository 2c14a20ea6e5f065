"""Join queries. ``now`` is the newest event time, so results do not depend on the clock."""
from pyspark.sql import functions as F

from tidegauge.functions.hashing import unit_hash
from tidegauge.operators import joins as J
from tidegauge.operators.vectors import top_k_cosine
from tidegauge.plans.common import LI_U, cents, labelled, LABELLED, li_u, u_sql
from tidegauge.plans.registry import query, rnd, table
from tidegauge.session import scratch

DAYS21, HOURS3 = 21 * 86400, 3 * 3600  # fixed values: ttl of the slow and the fast view


def views(spark, sf):
    e = table(spark, sf, "events")
    mk = lambda kind, ttl, name: J.FeatureView(
        e.where(F.col("event_type") == kind), "user_id", "ts", ["value", "event_id"], ttl, "event_id", name)
    return mk("view", DAYS21, "slow"), mk("click", HOURS3, "fast")


def now_of(spark, sf):
    """One-row scalar: the newest event time."""
    return table(spark, sf, "events").agg(F.max("ts").alias("now")).scalar()


@query("join_1", """with p as (select event_id, user_id, ts from events where event_type='purchase'),
 a as (select p.*, s.value sv, s.ts st from p asof left join (select * from events where event_type='view') s on p.user_id=s.user_id and p.ts>=s.ts),
 b as (select a.*, f.value fv, f.ts ft from a asof left join (select * from events where event_type='click') f on a.user_id=f.user_id and a.ts>=f.ts)
 select event_id, user_id, case when ts-st <= interval 21 days then sv end slow_value, case when ts-ft <= interval 3 hours then fv end fast_value from b""")
def join_1(spark, sf):
    slow, fast = views(spark, sf)
    asked = table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = J.point_in_time(asked, [slow, fast], "ts")
    return out.select("event_id", "user_id", F.col("slow__value").alias("slow_value"), F.col("fast__value").alias("fast_value"))


ONLINE = """(with n as (select max(ts) now from events), u as (select distinct user_id from events),
 s as (select user_id, arg_max(value, ts) v, max(ts) t from events where event_type='view' group by 1),
 f as (select user_id, arg_max(value, ts) v, max(ts) t from events where event_type='click' group by 1)
 select u.user_id, case when now-s.t <= interval 21 days then s.v end slow_value, case when now-f.t <= interval 3 hours then f.v end fast_value
 from u cross join n left join s using(user_id) left join f using(user_id))"""


@query("join_2", f"select * from {ONLINE}")
def join_2(spark, sf):
    keys = table(spark, sf, "events").select("user_id").distinct()
    out = J.online_features(keys, views(spark, sf), now_of(spark, sf))
    return out.select("user_id", F.col("slow__value").alias("slow_value"), F.col("fast__value").alias("fast_value"))


@query("join_3", """with n as (select max(ts) now from events) select user_id, arg_max(value, ts) as value, arg_max(event_id, ts) event_id, max(ts) ts
 from events, n where event_type='view' and ts between now - interval 21 days and now group by 1""")
def join_3(spark, sf):
    now = now_of(spark, sf)
    return J.materialize(views(spark, sf)[0], now - F.expr("interval 21 days"), now, scratch(spark, "serving")).select("user_id", "value", "event_id", "ts")


@query("join_4", f"select user_id, slow_value offline, slow_value online, true agree from {ONLINE}")
def join_4(spark, sf):
    keys = table(spark, sf, "events").select("user_id").distinct()
    slow, _ = views(spark, sf)
    offline = J.point_in_time(keys.withColumn("now", now_of(spark, sf)), [slow], "now")
    online = J.online_features(keys, [slow], now_of(spark, sf))
    return J.parity(offline, online, "user_id", "slow__value")


@query("join_5", f"""with t as (select * from lineitem where {LI_U} < 0.05), m as (select l_partkey, avg(l_extendedprice) m from t group by 1)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(m, (select avg(l_extendedprice) from t)),4) part_mean
 from lineitem left join m using (l_partkey) where {LI_U} >= 0.05""")
def join_5(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = J.lookup_with_global_mean(li.where(li_u() >= 0.05), li.where(li_u() < 0.05), "l_partkey", "l_extendedprice", "part_mean")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd("part_mean", 4).alias("part_mean"))


@query("join_6", f"""with d as (select doc_id, lang, md5(text) h, {u_sql('doc_id')} u from documents)
 select doc_id, lang from d where u >= 0.7 and h in (select h from d where u < 0.7)""")
def join_6(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("h"), unit_hash("doc_id").alias("u"))
    return J.overlap_audit(d.where("u < 0.7"), d.where("u >= 0.7"), ["h"]).select("doc_id", "lang")


@query("join_7", """with s as (select q.vec_id query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]),6) score,
  list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) raw from embeddings q, embeddings c)
 select query_id, vec_id, score from s qualify row_number() over (partition by query_id order by raw desc, vec_id) <= 10""")
def join_7(spark, sf):
    e = table(spark, sf, "embeddings")
    return top_k_cosine(e, e, "vec_id", "embedding", 10).select("query_id", "vec_id", rnd("score").alias("score"))


@query("join_8", """select l_orderkey, sum(l_quantity::BIGINT*round(p_retailprice*100)::BIGINT)::BIGINT total_cents, count(*) as lines
 from lineitem join part on l_partkey=p_partkey group by 1""")
def join_8(spark, sf):
    return J.order_totals(table(spark, sf, "lineitem"), table(spark, sf, "part"), "l_partkey", "p_partkey", "l_orderkey", "l_quantity", cents("p_retailprice"))


@query("join_9", """select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem l where not exists
 (select 1 from orders o where o_orderkey=l_orderkey and o_orderdate < timestamp '2001-01-01')""")
def join_9(spark, sf):
    """Lines whose order is missing from the book closed at the start of 2001."""
    book = table(spark, sf, "orders").where("o_orderdate < timestamp_ntz'2001-01-01'")
    return J.orphans(table(spark, sf, "lineitem"), book, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("join_10", f"""select doc_id, quality as label, case when p>=0.5 then 1 else 0 end pred, greatest(p,1-p) confidence,
 quality = case when p>=0.5 then 1 else 0 end correct from {LABELLED}""")
def join_10(spark, sf):
    pred = F.when(F.col("p") >= 0.5, 1).otherwise(0)
    return labelled(spark, sf, table).select("doc_id", F.col("quality").alias("label"), pred.alias("pred"),
                                             F.greatest(F.col("p"), 1 - F.col("p")).alias("confidence"), (F.col("quality") == pred).alias("correct"))


@query("join_11", f"""with c as (select c_custkey, c_acctbal, {u_sql('c_custkey')} < 0.3 missing from customer),
 s as (select r.c_custkey, d.c_custkey donor, abs(r.c_acctbal-d.c_acctbal) dist from c r, c d where r.missing and not d.missing)
 select c_custkey, donor, round(dist,6) distance, row_number() over (partition by c_custkey order by dist, donor) nth from s
 qualify nth <= 5""")
def join_11(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal").withColumn("u", unit_hash("c_custkey"))
    out = J.nearest_donors(c.where("u < 0.3"), c.where("u >= 0.3"), "c_custkey", "c_acctbal", 5)
    return out.select("c_custkey", "donor", rnd("distance").alias("distance"), F.col("nth").cast("long").alias("nth"))
