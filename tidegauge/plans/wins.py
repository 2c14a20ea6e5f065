"""Window queries."""
from pyspark.sql import functions as F

from tidegauge.operators import windows as W
from tidegauge.operators.joins import latest_per_key
from tidegauge.operators.vectors import top_k_cosine
from tidegauge.plans.aggs import DEBATES, debates
from tidegauge.plans.common import DAILY, LABELLED, MONTHLY, daily, labelled, monthly
from tidegauge.plans.registry import query, rnd, table

D = "date_format(d, 'yyyy-MM-dd')"
DS = "strftime(d,'%Y-%m-%d')"
MS = "strftime(m,'%Y-%m-%d')"


def day(c="d"):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@query("win_1", f"select series, {DS} d, y, " + ",".join(f"lag(y,{k}) over w lag_{k}" for k in range(1, 8)) + f" from {DAILY} window w as (partition by series order by d) qualify lag(y,7) over w is not null")
def win_1(spark, sf):
    out = W.lag_features(daily(table(spark, sf, "events")), "series", "d", "y", 7)
    return out.select("series", day(), "y", *[f"lag_{k}" for k in range(1, 8)])


@query("win_2", f"""select series, {MS} m, y, round(d1,4) diff_1, round(d1-lag(d1) over (partition by series order by m),4) diff_2 from
 (select *, y-lag(y) over (partition by series order by m) d1 from {MONTHLY})""")
def win_2(spark, sf):
    out = W.differences(monthly(table(spark, sf, "orders")), "series", "m", "y")
    return out.select("series", day("m"), "y", rnd("diff_1", 4).alias("diff_1"), rnd("diff_2", 4).alias("diff_2"))


@query("win_3", f"""select series, {DS} d, y as target, w[1] as oldest, w[12] as newest, len(w)::INT size, round(list_sum(w),4) total from
 (select *, list(y) over (partition by series order by d rows between 12 preceding and 1 preceding) w from {DAILY}) where len(w)=12""")
def win_3(spark, sf):
    out = W.sliding_arrays(daily(table(spark, sf, "events")), "series", "d", "y", 12)
    return out.select("series", day(), F.col("y").alias("target"), F.col("window")[0].alias("oldest"), F.col("window")[11].alias("newest"),
                      F.size("window").alias("size"), rnd(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("win_4", f"select series, {DS} d, round(avg(y) over w,4) rolling from {DAILY} window w as (partition by series order by d rows 6 preceding) qualify count(*) over w = 7")
def win_4(spark, sf):
    return W.rolling_mean(daily(table(spark, sf, "events")), "series", "d", "y", 7).select("series", day(), rnd("rolling", 4).alias("rolling"))


@query("win_5", "select event_id, row_number() over w seen, round(avg((value>50)::INT) over w,6) running_mean from events window w as (order by event_id rows unbounded preceding)")
def win_5(spark, sf):
    out = W.running_mean(table(spark, sf, "events").select("event_id", "value"), ["event_id"], (F.col("value") > 50).cast("int"))
    return out.select("event_id", "seen", rnd("running_mean").alias("running_mean"))


@query("win_6", f"""select doc_id, rn as rank, tp, rn-tp as fp, round(tp/rn,6) as precision, round(tp/(select sum(quality) from labels),6) as recall from
 (select doc_id, row_number() over w rn, (sum(quality) over w)::BIGINT tp from {LABELLED} window w as (order by p desc, doc_id rows unbounded preceding))""")
def win_6(spark, sf):
    out = W.ranked_precision_recall(labelled(spark, sf, table), "p", "doc_id", F.col("quality") == 1)
    return out.select("doc_id", "rank", "tp", "fp", rnd("precision").alias("precision"), rnd("recall").alias("recall"))


@query("win_7", "select s_suppkey, s_acctbal, row_number() over (order by s_acctbal desc, s_suppkey) place from supplier")
def win_7(spark, sf):
    return W.leaderboard(table(spark, sf, "supplier"), [-F.col("s_acctbal"), "s_suppkey"]).select("s_suppkey", "s_acctbal", "place")


@query("win_8", "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc)=1")
def win_8(spark, sf):
    return latest_per_key(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


NEAR = """(select query_id, row_number() over (partition by query_id order by raw desc, vec_id) as rank, vec_id, raw, ql, cl from
 (select q.vec_id query_id, c.vec_id, q.label ql, c.label cl, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) raw
  from embeddings q, embeddings c where q.vec_id<>c.vec_id) qualify rank <= 10)"""


def neighbours(spark, sf, k=10):
    """Ranked nearest other vectors of every vector with both labels."""
    e = table(spark, sf, "embeddings")
    lab = e.select("vec_id", "label")
    hits = top_k_cosine(e, e, "vec_id", "embedding", k, exclude_self=True)
    return hits.join(lab.withColumnRenamed("label", "cl"), "vec_id").join(
        lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")


@query("win_9", f"select query_id, min(rank) filter (ql=cl)::DOUBLE first_rank from {NEAR} group by 1")
def win_9(spark, sf):
    n = neighbours(spark, sf)
    return n.groupBy("query_id").agg(F.min(F.when(F.col("ql") == F.col("cl"), F.col("rank"))).cast("double").alias("first_rank"))


@query("win_10", f"""with t as (select *, case when count(*) over f = 13 then (sum(y) over f - (lag(y,6) over w + lead(y,6) over w)/2)/12 end trend from {MONTHLY}
  window w as (partition by series order by m), f as (partition by series order by m rows between 6 preceding and 6 following)),
 p as (select series, month(m) ph, avg(y-trend) s from t where trend is not null group by 1,2), q as (select series, ph, s-avg(s) over (partition by series) s from p)
 select series, {MS} m, round(trend,3) trend, round(s,3) seasonal, round(y-trend-s,3) resid from t left join q using (series) where month(m)=ph""")
def win_10(spark, sf):
    out = W.decompose(monthly(table(spark, sf, "orders")), "series", "m", "y", F.month("m"))
    return out.select("series", day("m"), rnd("trend", 3).alias("trend"), rnd("seasonal", 3).alias("seasonal"), rnd("resid", 3).alias("resid"))


@query("win_11", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10)))::BIGINT)) line_no from documents),
 f as (select *, regexp_matches(line, '^\S{0,14}$') sep from l)
 select doc_id, line_no::INT line_no, (sum(sep::INT) over (partition by doc_id order by line_no))%2=1 and not sep in_section from f""")
def win_11(spark, sf):
    return W.section_flags(table(spark, sf, "documents"), "doc_id", "text", r"^\S{0,14}$").select("doc_id", "line_no", "in_section")


WEEKLY = """(select event_type, datediff('day', timestamp '2024-01-01', ts)//7 wk, avg(value) m from events group by 1,2)"""


@query("win_12", f"""with b as (select *, m > 48 b from {WEEKLY}), r as (select *, b and lag(b) over (partition by event_type order by wk) s from b)
 select event_type, min(wk) filter (b)::DOUBLE first_week, min(wk) filter (s)::DOUBLE sustained_week from r group by 1""")
def win_12(spark, sf):
    e = table(spark, sf, "events").withColumn("wk", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7))
    weekly = e.groupBy("event_type", "wk").agg(F.avg("value").alias("m"))
    out = W.first_breach(weekly, "event_type", "wk", F.col("m") > 48, 2)
    return out.select("event_type", F.col("first_week").cast("double").alias("first_week"), F.col("sustained_week").cast("double").alias("sustained_week"))


@query("win_13", f"""select conv_id, turn, role, row_number() over w seq, row_number() over w - 1 statements_before,
 coalesce(sum(length(said)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding),0)::BIGINT chars_before from {DEBATES} window w as (partition by conv_id order by turn)""")
def win_13(spark, sf):
    return W.turn_order(debates(spark, sf), "conv_id", "turn", "role", "said")
