"""Streaming and user-function queries. The stream reads the events file of the given folder to its end."""
from pyspark.sql import functions as F

from tidegauge.functions import udfs as U
from tidegauge.operators import metrics as MT
from tidegauge.operators import ml as M
from tidegauge.operators.ordering import exact_quantiles
from tidegauge.operators.stats import bin_index
from tidegauge.plans.common import LABELLED, LI_KEYS, cents, labelled
from tidegauge.plans.models import LINE, sql_model
from tidegauge.plans.registry import query, rnd, table
from tidegauge.plans.stat import PSI
from tidegauge.session import scratch, settle
from tidegauge.streaming import expiry as X
from tidegauge.streaming import streams as S


def events_stream(spark, sf):
    return S.file_stream(spark, sf, table(spark, sf, "events"), "events.parquet")


WEEK = {"length": "7 days", "start": "4 days"}  # fixed values: weeks begin on Monday


@query("str_1", f"select event_type, strftime(date_trunc('week',ts),'%Y-%m-%d') as start, count(*) n, sum(round(value*100)::BIGINT)::BIGINT cents, count(*) filter (value>50) flagged from events group by 1,2")
def str_1(spark, sf):
    aggs = {"n": F.count(F.lit(1)), "cents": F.sum(cents("value")), "flagged": F.count_if(F.col("value") > 50)}
    s = S.windowed_metrics(events_stream(spark, sf), "ts", "event_type", aggs, **WEEK)
    out = S.newest(S.drain_to_table(s, "update", "weekly"), ["event_type", "start"], list(aggs))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("str_2", """with d as (select unnest(generate_series(timestamp '2023-12-20', timestamp '2024-02-10', interval 1 day)) s)
 select event_type, strftime(s,'%Y-%m-%d') as start, count(*) n, round(avg((value>50)::INT),6) rate from events join d on ts >= s and ts < s + interval 7 days group by 1,2""")
def str_2(spark, sf):
    aggs = {"n": F.count(F.lit(1)), "rate": F.avg((F.col("value") > 50).cast("int"))}
    s = S.windowed_metrics(events_stream(spark, sf), "ts", "event_type", aggs, "7 days", "1 day")
    out = S.newest(S.drain_to_table(s, "update", "sliding"), ["event_type", "start"], ["n", "rate"])
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("start"), "n", rnd("rate").alias("rate"))


FRESH = """with l as (select user_id, event_id, value, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc)=1)
 select user_id, event_id, value from l where ts >= (select max(ts) from events) - interval 3 hours"""


@query("str_3", FRESH)
def str_3(spark, sf):
    """The newest event of each user, served for three hours."""
    s = S.latest_values(events_stream(spark, sf), "ts", "user_id", ["ts", "event_id"], ["event_id", "value"], "3 hours", "40 days")
    return S.unexpired(S.drain_to_table(s, "update", "fast-features"), "ts", "user_id", ["ts", "event_id"], ["event_id", "value"], "3 hours")


@query("str_3_ttl", FRESH)
def str_3_ttl(spark, sf):
    """The same by keyed state: a timer ends a user's value three hours after it, whether or not the user sends another."""
    columns = ["event_id", "value"]
    s = X.expiring_values(events_stream(spark, sf), "ts", "user_id", ["ts", "event_id"], columns, 3 * 3600, "40 days")
    with X.rocks_state(spark):
        changes = S.drain_to_table(s, "update", "expiring-features")
    return X.current_values(changes, "user_id", columns, 3 * 3600)


@query("str_4", "select event_id, user_id, value from events where value > 0.05")
def str_4(spark, sf):
    """The same events arrive twice, one delivery after the other; the store ends with each valid one once."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    src, store = scratch(spark, "replayed"), scratch(spark, "event-store")
    e.write.parquet(src)
    files = len(spark.read.parquet(src).inputFiles())
    e.write.mode("append").parquet(src)
    e.where("false").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(store)
    S.ingest_once(S.file_stream(spark, src, e, files_per_batch=files), "ts", "event_id", store, F.col("value") > 0.05, "ingest", "40 days")
    return spark.read.parquet(store).select("event_id", "user_id", "value")


@query("str_5", f"select event_type, strftime(timestamp '2024-01-01' + to_days((wk*7)::INT),'%Y-%m-%d') as start, round(psi,6)+0.0 psi from {PSI}")
def str_5(spark, sf):
    e = table(spark, sf, "events")
    first = e.where("ts < timestamp_ntz'2024-01-08'")
    edges = settle(exact_quantiles(first, "value", [i / 10 for i in range(1, 10)], ["event_type"], "_edges").select("event_type", "_edges"), "edges")
    ref = first.join(edges, "event_type").groupBy("event_type").agg(F.array(*[F.count_if(bin_index(F.col("value"), F.col("_edges")) == i) for i in range(10)]).alias("_ref"))
    s = S.streamed_bins(events_stream(spark, sf), edges, "ts", "event_type", "value", **WEEK)
    cols = [f"b{i}" for i in range(10)]
    got = S.newest(S.drain_to_table(s, "update", "bins"), ["event_type", "start"], cols).join(ref, "event_type")
    return got.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("start"), rnd(S.psi_of_counts(F.array(*cols), F.col("_ref"))).alias("psi"))


@query("str_6", f"select event_id, round(a+b*k,4) predicted from (select event_id, json_extract(props,'$.k')::DOUBLE k from events), (select regr_slope(value, json_extract(props,'$.k')::DOUBLE) b, regr_intercept(value, json_extract(props,'$.k')::DOUBLE) a from events)")
def str_6(spark, sf):
    """A model fitted on the batch table scores the stream event by event."""
    feat = lambda d: d.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    m = M.linear(feat(table(spark, sf, "events")), ["k"], "value")
    s = m.transform(M.assembled(feat(events_stream(spark, sf)), ["k"])).select("event_id", "prediction")
    return S.drain_to_table(s, "append", "scored").select("event_id", rnd("prediction", 4).alias("predicted"))


@query("udf_1", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a+b*l_quantity,3) predicted from lineitem, {LINE}")
def udf_1(spark, sf):
    m = M.linear(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    U.register_linear(spark, "tg_predict_price", m.intercept, m.coefficients)
    table(spark, sf, "lineitem").createOrReplaceTempView("tg_lines")
    return spark.sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(tg_predict_price(l_quantity), 3) + 0D AS predicted FROM tg_lines")


@query("udf_2", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(a+b*l_quantity,3) predicted from lineitem, {LINE}")
def udf_2(spark, sf):
    m = sql_model(spark, sf)
    out = U.score_query(spark, m, f"SELECT {', '.join(LI_KEYS)}, l_quantity FROM tg_lines", "l_extendedprice")
    return out.select(*LI_KEYS, "l_quantity", rnd("predicted_l_extendedprice", 3).alias("predicted"))


@query("udf_2_table", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(a+b*l_quantity,3) predicted from lineitem, {LINE}")
def udf_2_table(spark, sf):
    """The same scores by a table function that takes any query."""
    m = M.linear(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    U.register_table_scorer(spark, "tg_score_lines", m.intercept, {"l_quantity": float(m.coefficients[0])}, "price")
    table(spark, sf, "lineitem").createOrReplaceTempView("tg_lines")
    return spark.sql(f"SELECT {', '.join(LI_KEYS)}, l_quantity, round(predicted_price, 3) + 0D AS predicted FROM tg_score_lines(TABLE(SELECT {', '.join(LI_KEYS)}, l_quantity FROM tg_lines))")


@query("udf_3", "select event_type, case when event_type='click' then case when value>50 then 'bid' else 'pass' end when event_type='view' then 'pass' end as action, count(*) n from events group by 1,2")
def udf_3(spark, sf):
    policies = {"click": lambda d: d["value"].gt(50).map({True: "bid", False: "pass"}), "view": lambda d: d["value"].map(lambda _: "pass")}
    out = U.apply_policies(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", policies)
    return out.groupBy("event_type", "action").agg(F.count(F.lit(1)).alias("n"))


@query("udf_4", f"""with d as (select lang, quality y, p, (p>=0.5)::INT q, toxic from {LABELLED}), g as (select lang, avg(pow(p-y,2)) b, avg(y)*(1-avg(y)) r,
 (coalesce(2.0*count(*) filter (y=0 and q=0)/nullif(count(*) filter (y=0)+count(*) filter (q=0),0),0)+coalesce(2.0*count(*) filter (y=1 and q=1)/nullif(count(*) filter (y=1)+count(*) filter (q=1),0),0))/2 f from d group by 1)
 select lang, round(b,6) brier, round(1-b/nullif(r,0),6) skill, round(f,6) macro_f1, round(psi,6)+0.0 psi from g join (select lang, """ + "+".join(
    f"(greatest(count(*) filter (toxic=1 and least(floor(p*10),9)={i})/nullif(count(*) filter (toxic=1),0),0.0001::DOUBLE)-greatest(count(*) filter (toxic=0 and least(floor(p*10),9)={i})/nullif(count(*) filter (toxic=0),0),0.0001::DOUBLE))*ln(greatest(count(*) filter (toxic=1 and least(floor(p*10),9)={i})/nullif(count(*) filter (toxic=1),0),0.0001::DOUBLE)/greatest(count(*) filter (toxic=0 and least(floor(p*10),9)={i})/nullif(count(*) filter (toxic=0),0),0.0001::DOUBLE))" for i in range(10)) + " psi from d group by 1) using (lang)")
def udf_4(spark, sf):
    """Skill, macro F1 and stability index as aggregates of one groupBy."""
    y, p = F.col("quality"), F.col("p")
    b = F.least(F.floor(p * 10), F.lit(9))
    d = labelled(spark, sf, table).groupBy("lang").agg(
        *MT.brier_columns(y, p), U.macro_f1_column(y, (p >= 0.5).cast("int"), [0, 1]).alias("macro_f1"), U.psi_column(b, F.col("toxic") == 1, F.col("toxic") == 0).alias("psi"))
    return d.select("lang", *[rnd(c).alias(c) for c in ("brier", "skill", "macro_f1", "psi")])
