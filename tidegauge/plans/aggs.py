"""Aggregation queries."""
from pyspark.sql import functions as F

from tidegauge.functions.hashing import unit_hash
from tidegauge.functions.scalar import extract_verdict
from tidegauge.operators import aggregates as A
from tidegauge.plans.common import u_sql
from tidegauge.plans.registry import query, rnd, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = "(" + " union all ".join(f"select '{c}' as \"column\", {c} as value from lineitem" for c in NUM) + ")"


@query("agg_1", f"""select "column", count(value) as count, round(avg(value),6) mean, round(stddev_samp(value),6) std, min(value) min, max(value) max,
 round(quantile_cont(value,0.25),6) q25, round(quantile_cont(value,0.5),6) q50, round(quantile_cont(value,0.75),6) q75, lower(any_value(typeof(value))) dtype,
 (select count(*) from lineitem) n_rows, (select count(*) from (describe lineitem))::INT n_columns from {LONG} group by 1""")
def agg_1(spark, sf):
    p = A.numeric_profile(table(spark, sf, "lineitem"), NUM)
    return p.select("column", "count", rnd("mean").alias("mean"), rnd("std").alias("std"), "min", "max", *[rnd(c).alias(c) for c in ("q25", "q50", "q75")], "dtype", "n_rows", "n_columns")


def gappy_orders(spark, sf):
    hide = lambda c, s: F.when(unit_hash("o_orderkey", seed=s) >= 0.2, F.col(c)).alias(c)
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", hide("o_totalprice", 1), hide("o_custkey", 2), hide("o_orderpriority", 3))


GAPPY = "(select o_orderkey, o_orderstatus, " + ", ".join(
    f"case when {u_sql('o_orderkey', seed=s)} >= 0.2 then {c} end {c}" for c, s in (("o_totalprice", 1), ("o_custkey", 2), ("o_orderpriority", 3))) + " from orders)"


@query("agg_2", """with t as (select case when """ + u_sql("doc_id", seed=1) + """ >= 0.1 then lang end lang, case when """ + u_sql("doc_id", seed=2) + """ >= 0.25 then source end source, n_chars from documents)
 select 'lang' as "column", count(*)-count(lang) as missing, round(100.0*(count(*)-count(lang))/count(*),6) pct from t
 union all select 'source', count(*)-count(source), round(100.0*(count(*)-count(source))/count(*),6) from t
 union all select 'n_chars', count(*)-count(n_chars), round(100.0*(count(*)-count(n_chars))/count(*),6) from t""")
def agg_2(spark, sf):
    d = table(spark, sf, "documents").select(
        F.when(unit_hash("doc_id", seed=1) >= 0.1, F.col("lang")).alias("lang"), F.when(unit_hash("doc_id", seed=2) >= 0.25, F.col("source")).alias("source"), "n_chars")
    return A.missingness(d, ["lang", "source", "n_chars"]).withColumn("pct", rnd("pct"))


@query("agg_3", f"""select o_orderstatus, (o_totalprice is null)::INT||''||(o_custkey is null)::INT||(o_orderpriority is null)::INT mask, count(*) n from {GAPPY} group by 1,2""")
def agg_3(spark, sf):
    return A.missing_pattern(gappy_orders(spark, sf), ["o_totalprice", "o_custkey", "o_orderpriority"], ["o_orderstatus"])


@query("agg_4", f"select t event_type, count(*) n, round(count(*)*1.0/sum(count(*)) over (),6) as share from (select case when {u_sql('event_id')} >= 0.1 then event_type end t from events) group by 1")
def agg_4(spark, sf):
    e = table(spark, sf, "events").select(F.when(unit_hash("event_id") >= 0.1, F.col("event_type")).alias("event_type"))
    return A.value_counts(e, "event_type").withColumn("share", rnd("share"))


@query("agg_5", """select o_orderpriority, count(*) filter (o_orderstatus='F') as "F", count(*) filter (o_orderstatus='O') as "O", count(*) filter (o_orderstatus='P') as "P" from orders group by 1""")
def agg_5(spark, sf):
    return A.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("agg_6", "select l_suppkey, count(*) n, round(avg(l_extendedprice),4) mean from lineitem group by 1")
def agg_6(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("l_extendedprice"), 4).alias("mean"))


@query("agg_7", """with e as (select min(value) lo, max(value) hi from events), c as (select least(floor((value-lo)/((hi-lo)/20)),19)::INT bin, count(*) n from events, e group by 1)
 select b::INT bin, round(lo+b*((hi-lo)/20),6) as left, coalesce(n,0) n from range(20) r(b) cross join e left join c on bin=b""")
def agg_7(spark, sf):
    return A.histogram(table(spark, sf, "events"), "value", 20).withColumn("left", rnd("left"))


@query("agg_8", """with q as (select o_orderstatus, count(*) n, quantile_cont(o_totalprice,0.25) q1, quantile_cont(o_totalprice,0.5) median, quantile_cont(o_totalprice,0.75) q3 from orders group by 1)
 select o_orderstatus, n, round(q1,4) q1, round(median,4) median, round(q3,4) q3, min(case when inn then p end) low, max(case when inn then p end) high, count(*) filter (not inn) outliers
 from (select q.*, o_totalprice p, o_totalprice between q1-1.5*(q3-q1) and q3+1.5*(q3-q1) inn from orders join q using (o_orderstatus)) group by all""")
def agg_8(spark, sf):
    b = A.box_summary(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")
    return b.withColumns({c: rnd(c, 4) for c in ("q1", "median", "q3")})


@query("agg_9", " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a},{b}),6)+0.0 r from lineitem" for i, a in enumerate(NUM) for b in NUM[i + 1:]))
def agg_9(spark, sf):
    return A.correlations(table(spark, sf, "lineitem"), NUM).withColumn("r", rnd("r"))


@query("agg_10", """select round(avg(c_acctbal),6) mean, round(quantile_cont(c_acctbal,0.5),6) median,
 (select c_acctbal from customer group by 1 order by count(*) desc, c_acctbal limit 1) as mode from customer""")
def agg_10(spark, sf):
    s = A.fit_statistics(table(spark, sf, "customer"), "c_acctbal")
    return s.select(rnd("mean").alias("mean"), rnd("median").alias("median"), "mode")


def debates(spark, sf):
    """Conversations as debates: the role speaks, two turns make a round, the vote depends on the key hash."""
    c = table(spark, sf, "conversations")
    u = unit_hash("conv_id", "turn")
    tag = F.when(u < 0.55, " VERDICT: yes").when(u < 0.8, "\nVerdict:NO").otherwise("")
    said = c.withColumn("said", F.concat("text", tag)).withColumn("round_no", F.floor(F.col("turn") / 2).cast("long"))
    return said.withColumn("verdict", extract_verdict("said"))


DEBATES = f"""(select conv_id, turn, role, text, turn//2 round_no, said, nullif(upper(regexp_extract(said,'(?i)VERDICT:\\s*([A-Za-z_][A-Za-z0-9_]*)',1)),'') verdict
 from (select *, text||case when u<0.55 then ' VERDICT: yes' when u<0.8 then chr(10)||'Verdict:NO' else '' end said from
 (select *, {u_sql('conv_id', 'turn')} u from conversations)))"""

TALLY = f"""(with l as (select * from {DEBATES} qualify row_number() over (partition by conv_id, role order by turn desc)=1),
 n as (select conv_id, count(*) speakers, count(verdict) votes from l group by 1),
 t as (select conv_id, verdict, count(*) c from l where verdict is not null group by 1,2),
 w as (select t.conv_id, verdict winner from t join n using(conv_id) where c*2 > speakers)
 select n.conv_id, speakers::BIGINT speakers, votes::BIGINT votes, winner, winner is null deadlock from n left join w using(conv_id))"""


@query("agg_11", f"select * from {TALLY}")
def agg_11(spark, sf):
    return A.tally(debates(spark, sf), "conv_id", "role", "turn", "verdict")


OUTCOME = f"""(with r as (select conv_id, round_no, count(*)=count(verdict) and min(verdict)=max(verdict) agreed, min(verdict) v from {DEBATES} group by 1,2)
 select conv_id, coalesce(min(round_no) filter (agreed), max(round_no)) rounds_run, case when bool_or(agreed) then 'unanimous' else 'max_rounds' end stop_reason,
 bool_or(agreed) unanimous, arg_min(v, round_no) filter (agreed) winner from r group by 1)"""


@query("agg_12", f"select * from {OUTCOME}")
def agg_12(spark, sf):
    return A.debate_outcome(debates(spark, sf), "conv_id", "role", "round_no", "verdict")


@query("agg_13", "select lang, count(*) n, round(count(*)*100.0/sum(count(*)) over (),6) pct from documents group by 1")
def agg_13(spark, sf):
    return A.value_counts(table(spark, sf, "documents"), "lang").select("lang", "n", rnd(F.col("share") * 100).alias("pct"))


@query("agg_14", "select doc_id, lang from documents qualify row_number() over (partition by text, lang order by doc_id)=1")
def agg_14(spark, sf):
    return A.keep_first(table(spark, sf, "documents"), ["text", "lang"], "doc_id").select("doc_id", "lang")


@query("agg_15", """select event_type, count(*) episodes, round(avg((value>50)::INT),6) win_rate, round(avg(value),6) mean_reward,
 round(avg(json_extract(props,'$.k')::INT),6) mean_steps from events group by 1""")
def agg_15(spark, sf):
    e = table(spark, sf, "events").withColumn("steps", F.get_json_object("props", "$.k").cast("int"))
    s = A.episode_summary(e, "event_type", F.col("value") > 50, "value", "steps")
    return s.withColumns({c: rnd(c) for c in ("win_rate", "mean_reward", "mean_steps")})


@query("agg_16", """with t as (select *, round(l_extendedprice*100)::BIGINT m, l_shipdate >= timestamp '1999-01-01' test from lineitem),
 w as (select sum(m) filter (test) t, sum(m) filter (not test) c from t)
 select l_returnflag, l_linestatus, grouping_id(l_returnflag,l_linestatus)::BIGINT as "grouping", sum(case when test then m else 0 end)::BIGINT test, sum(case when test then 0 else m end)::BIGINT control,
 round(sum(case when test then m else 0 end)/any_value(w.t),6) test_share, round(sum(case when test then 0 else m end)/any_value(w.c),6) control_share,
 (sum(case when test then m else 0 end)-sum(case when test then 0 else m end))::BIGINT difference from t, w group by cube(l_returnflag,l_linestatus)""")
def agg_16(spark, sf):
    li = table(spark, sf, "lineitem")
    c = A.contribution(li, ["l_returnflag", "l_linestatus"], F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return c.withColumns({x: rnd(x) for x in ("test_share", "control_share")})


DIMS_16 = "l_returnflag,l_linestatus,l_linenumber,l_tax,l_discount"


@query("agg_16_frequent", f"""with t as (select *, round(l_extendedprice*100)::BIGINT m, l_shipdate >= timestamp '1999-01-01' test from lineitem),
 w as (select count(*) n, sum(m) filter (test) t, sum(m) filter (not test) c from t)
 select {DIMS_16.replace("l_linenumber", "l_linenumber::DOUBLE l_linenumber")}, grouping_id({DIMS_16})::BIGINT as "grouping", count(*) n, sum(case when test then m else 0 end)::BIGINT test, sum(case when test then 0 else m end)::BIGINT control,
 round(sum(case when test then m else 0 end)/any_value(w.t),6) test_share, round(sum(case when test then 0 else m end)/any_value(w.c),6) control_share,
 (sum(case when test then m else 0 end)-sum(case when test then 0 else m end))::BIGINT difference from t, w group by cube({DIMS_16}) having count(*) >= 0.02::DOUBLE*any_value(w.n)""")
def agg_16_frequent(spark, sf):
    """Contribution over five dimensions, cells of at least two in a hundred rows only."""
    c = A.frequent_contribution(table(spark, sf, "lineitem"), DIMS_16.split(","), F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"), 0.02)
    return c.select(*[F.col(d).cast("double").alias(d) if d == "l_linenumber" else d for d in DIMS_16.split(",")], "grouping", "n", "test", "control", rnd("test_share").alias("test_share"), rnd("control_share").alias("control_share"), "difference")


@query("agg_17", """select coalesce(p_brand,'TOTAL') p_brand, count(*) parts, sum(p_size)::BIGINT sizes, max(p_retailprice) top_price from part group by rollup(p_brand)""")
def agg_17(spark, sf):
    return A.with_total(table(spark, sf, "part"), "p_brand", [F.count(F.lit(1)).alias("parts"), F.sum("p_size").alias("sizes"), F.max("p_retailprice").alias("top_price")])


@query("agg_18", f"""select case when {u_sql('doc_id')} < 0.8 then 'train' else 'test' end split, quality, count(*) n,
 round(count(*)*1.0/sum(count(*)) over (partition by case when {u_sql('doc_id')} < 0.8 then 'train' else 'test' end),6) as share from labels group by 1,2""")
def agg_18(spark, sf):
    split = F.when(unit_hash("doc_id") < 0.8, "train").otherwise("test")
    return A.load_profile(table(spark, sf, "labels"), split, "quality").withColumn("share", rnd("share"))
