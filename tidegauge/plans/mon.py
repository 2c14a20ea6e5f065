"""Monitoring queries: the reference window is the first seven days of each event type."""
from pyspark.sql import functions as F

from tidegauge.functions.hashing import unit_hash
from tidegauge.operators import monitoring as M
from tidegauge.plans.common import LABELLED, labelled, u_sql
from tidegauge.plans.registry import query, rnd, table
from tidegauge.plans.stat import KS, KS_P, PSI, WEEKED, weeked
from tidegauge.session import scratch


def scored_events(spark, sf):
    e = weeked(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.withColumns({"label": (F.col("value") > 40).cast("int"), "pred": (F.col("value") + F.col("k") * 0.3 > 50).cast("int")})


ACC = f"(select event_type, wk, avg(((value>40)=(value+json_extract(props,'$.k')::INT*0.3::DOUBLE>50))::INT) acc, avg((value+json_extract(props,'$.k')::INT*0.3::DOUBLE>50)::INT) ppr from {WEEKED} group by 1,2)"
REPORT = f"(select p.event_type, p.wk, p.n, psi, d, {KS_P} ks_p, acc, ppr from {PSI} p join (select event_type, wk, n, n_ref, d from {KS}) k using (event_type, wk, n) join {ACC} using (event_type, wk))"


@query("mon_1", f"select event_type, wk, n, round(psi,6)+0.0 psi, round(d,6) ks_d, round(ks_p,6) ks_p, round(acc,6) accuracy, round(ppr,6) pred_positive_rate, case when psi<0.1 then 'stable' when psi<0.25 then 'moderate shift' else 'significant drift' end status from {REPORT}")
def mon_1(spark, sf):
    r = M.drift_report(scored_events(spark, sf), F.col("wk") == 0, "value", "event_type", "wk", "label", "pred")
    return r.select("event_type", "wk", "n", *[rnd(c).alias(c) for c in ("psi", "ks_d", "ks_p", "accuracy", "pred_positive_rate")], "status")


def trigger_sql(limit, drop, m):
    return f"""with r as (select r.event_type, wk, psi >= {limit} ph, acc < (select acc from {ACC} b where b.event_type=r.event_type and b.wk=0) - {drop}::DOUBLE ah from {REPORT} r),
 s as (select *, ph or ah b, (ph or ah) and coalesce(lag(ph or ah) over (partition by event_type order by wk),false) run from r)
 select event_type, min(wk) filter (ph)::DOUBLE psi_week, min(wk) filter (ah)::DOUBLE accuracy_week, min(wk) filter (b)::DOUBLE first_week, min(wk) filter (run)::DOUBLE sustained_week, bool_or(b) retrain from s group by 1"""


def triggers(spark, sf, limit, drop):
    e = scored_events(spark, sf)
    r = M.drift_report(e, F.col("wk") == 0, "value", "event_type", "wk", "label", "pred")
    base = e.where("wk = 0").groupBy("event_type").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("base"))
    t = M.retrain_trigger(r, "event_type", "wk", base, limit, drop)
    return t.select("event_type", *[F.col(c).cast("double").alias(c) for c in ("psi_week", "accuracy_week", "first_week", "sustained_week")], "retrain")


@query("mon_2", trigger_sql(0.25, 0.10, 2))
def mon_2(spark, sf):
    return triggers(spark, sf, 0.25, 0.10)


@query("mon_3", trigger_sql(0.02, 0.01, 2))
def mon_3(spark, sf):
    """Tight limits, where single crossings and sustained breaches differ."""
    return triggers(spark, sf, 0.02, 0.01)


@query("mon_4", f"""with s as (select case when {u_sql('doc_id')} < 0.4 then 'recent' else 'golden' end g, quality y, (p>=0.5)::INT a, (p>=0.3)::INT b from {LABELLED}), m as (select g, count(*) n, avg((a=y)::INT) c, avg((b=y)::INT) d from s group by 1)
 select count(*) sets, sum(n)::BIGINT n, bool_and(d>=c) promote, round(min(d-c),6)+0.0 worst_gain from m""")
def mon_4(spark, sf):
    d = labelled(spark, sf, table).withColumns({"set": F.when(unit_hash("doc_id") < 0.4, "recent").otherwise("golden"), "champ": (F.col("p") >= 0.5).cast("int"), "chall": (F.col("p") >= 0.3).cast("int")})
    return M.promotion_gate(d, "set", "quality", "champ", "chall").withColumn("worst_gain", rnd("worst_gain"))


@query("mon_5", """select source, count(*) predictions, count(quality) labelled, round(count(quality)/count(*),6) coverage, round(avg((quality=(n_chars>=600)::INT)::INT),6) accuracy from documents left join labels using (doc_id) group by 1""")
def mon_5(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") >= 600).cast("int").alias("pred"))
    c = M.label_coverage(p, table(spark, sf, "labels"), "doc_id", "source", "quality", "pred")
    return c.withColumns({x: rnd(x) for x in ("coverage", "accuracy")})


@query("mon_6", "select lang, count(*) n, sum(n_chars)::BIGINT chars from documents group by 1")
def mon_6(spark, sf):
    """The second freeze of the day is refused, so the snapshot still holds the first rows."""
    root, d = scratch(spark, "golden"), table(spark, sf, "documents")
    M.freeze_once(d, root, "golden", "2024-01-31")
    again = M.freeze_once(d.where("lang = 'en'"), root, "golden", "2024-01-31")
    return again.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
