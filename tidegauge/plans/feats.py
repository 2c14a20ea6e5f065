"""Feature-preparation queries."""
from pyspark.sql import functions as F

from tidegauge.functions.hashing import unit_hash
from tidegauge.operators import features as X
from tidegauge.operators.stats import standardise
from tidegauge.plans.aggs import GAPPY, gappy_orders
from tidegauge.plans.common import LI_GEO, LI_U, cents, li_u, u_sql, with_geo
from tidegauge.plans.registry import query, rnd, table
from tidegauge.plans.stat import LEVELS
from tidegauge.session import settle

CITY = (40.58, 40.92, -74.26, -73.75)  # fixed values: the city box (lat, lat, lon, lon)
LK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K4 = ", ".join(LK)


def spend(spark, sf):
    """Balance and order value per customer; 30 % of the order values are hidden by hash."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum(cents("o_totalprice")) / F.lit(100.0)).alias("spend"))
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").join(o, "c_custkey")
    c = X.mask(c, "spend", "c_custkey").withColumn("u", unit_hash("c_custkey", seed=9))
    c = c.withColumn("c_mktsegment", F.when(unit_hash("c_custkey", seed=3) >= 0.1, F.col("c_mktsegment")))
    return settle(c, "spend")  # a per-customer table that many branches read


SPEND = f"""(select c_custkey, c_acctbal, case when {u_sql('c_custkey', seed=3)} >= 0.1 then c_mktsegment end c_mktsegment, truth, case when {u_sql('c_custkey')} < 0.3 then null else truth end spend, {u_sql('c_custkey', seed=9)} u
 from customer join (select o_custkey c_custkey, sum(round(o_totalprice*100)::BIGINT)::BIGINT/100.0::DOUBLE truth from orders group by 1) using (c_custkey))"""


@query("feat_1", f"""with s as (select * from {SPEND}), t as (select avg(spend) m, quantile_cont(spend,0.5) med from s where u >= 0.25)
 select c_custkey, round(coalesce(spend,m),4) mean_filled, round(coalesce(spend,med),4) median_filled, coalesce(spend,-1) constant_filled from s, t""")
def feat_1(spark, sf):
    s = spend(spark, sf)
    fit = s.where("u >= 0.25")
    s = X.impute(s, "spend", "mean", fit, name="mean_filled")
    s = X.impute(s, "spend", "median", fit, name="median_filled")
    s = X.impute(s, "spend", "constant", constant=-1.0, name="constant_filled")
    return s.select("c_custkey", rnd("mean_filled", 4).alias("mean_filled"), rnd("median_filled", 4).alias("median_filled"), "constant_filled")


@query("feat_2", f"select o_orderkey, coalesce(o_orderpriority, (select o_orderpriority from {GAPPY} where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1)) o_orderpriority from {GAPPY}")
def feat_2(spark, sf):
    return X.impute(gappy_orders(spark, sf), "o_orderpriority", "most_frequent").select("o_orderkey", "o_orderpriority")


@query("feat_3", f"select c_custkey, (spend is null)::INT spend_missing, c_acctbal_missing from (select *, null::DOUBLE c_acctbal_missing from {SPEND})")
def feat_3(spark, sf):
    s = spend(spark, sf)
    out = X.missing_indicators(s, ["spend", "c_acctbal"], s.where("u >= 0.25"))
    return out.select("c_custkey", "spend_missing", F.col("c_acctbal_missing").cast("double").alias("c_acctbal_missing"))


KNN = f"""(with s as (select * from {SPEND}), d as (select r.c_custkey, d.spend, row_number() over (partition by r.c_custkey order by abs(r.c_acctbal-d.c_acctbal), d.c_custkey) n from s r, s d where r.spend is null and d.spend is not null),
 f as (select c_custkey, avg(spend) fill from d where n <= 5 group by 1) select s.c_custkey, c_acctbal, coalesce(spend, fill) spend from s left join f using (c_custkey))"""


@query("feat_4", f"select c_custkey, round(spend,4) spend from {KNN}")
def feat_4(spark, sf):
    return X.knn_impute(spend(spark, sf), "c_custkey", "c_acctbal", "spend").select("c_custkey", rnd("spend", 4).alias("spend"))


@query("feat_5", f"""with s as (select * from {SPEND}), a as (select 'truth' strategy, c_acctbal, truth v from s union all select 'mean', c_acctbal, coalesce(spend, (select avg(spend) from s)) from s
 union all select 'median', c_acctbal, coalesce(spend, (select quantile_cont(spend,0.5) from s)) from s union all select 'knn', c_acctbal, spend from {KNN}),
 g as (select strategy, stddev_samp(v) s, corr(v, c_acctbal) c from a group by 1), t as (select s ts, c tc from g where strategy='truth')
 select strategy, round(s,3) std, round(c,6)+0.0 corr, round((s-ts)/ts*100,5)+0.0 std_change_pct, round((c-tc)/tc*100,3)+0.0 corr_change_pct from g, t""")
def feat_5(spark, sf):
    s = spend(spark, sf)
    out = X.scorecard({
        "truth": s.select("c_acctbal", F.col("spend_true").alias("spend")), "mean": X.impute(s, "spend", "mean"),
        "median": X.impute(s, "spend", "median"), "knn": X.knn_impute(s, "c_custkey", "c_acctbal", "spend")}, "spend", "c_acctbal")
    return out.select("strategy", rnd("std", 3).alias("std"), rnd("corr").alias("corr"), rnd("std_change_pct", 5).alias("std_change_pct"), rnd("corr_change_pct", 3).alias("corr_change_pct"))


@query("feat_6", f"select c_custkey, case when {u_sql('c_custkey')} >= 0.3 then c_acctbal end c_acctbal, c_acctbal c_acctbal_true from customer")
def feat_6(spark, sf):
    return X.mask(table(spark, sf, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "c_acctbal", "c_acctbal_true")


@query("feat_7", f"select count(*) before, count(*) filter (o_totalprice is not null and o_custkey is not null and o_orderpriority is not null) after, round(100.0*(count(*)-count(*) filter (o_totalprice is not null and o_custkey is not null and o_orderpriority is not null))/count(*),6) lost_pct from {GAPPY}")
def feat_7(spark, sf):
    return X.drop_cost(gappy_orders(spark, sf), ["o_totalprice", "o_custkey", "o_orderpriority"]).withColumn("lost_pct", rnd("lost_pct"))


@query("feat_8", f"""with t as (select avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) mp, stddev_pop(l_extendedprice) sp from lineitem where {LI_U} >= 0.25)
 select {K4}, round((l_quantity-mq)/sq,6)+0.0 q, round((l_extendedprice-mp)/sp,6)+0.0 p from lineitem, t""")
def feat_8(spark, sf):
    li = table(spark, sf, "lineitem")
    z = standardise(li, ["l_quantity", "l_extendedprice"], li.where(li_u() >= 0.25))
    return z.select(*LK, rnd("l_quantity_z").alias("q"), rnd("l_extendedprice_z").alias("p"))


@query("feat_9", f"""with t as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem where {LI_U} >= 0.25) select {K4}, round((l_extendedprice-lo)/(hi-lo),6)+0.0 p from lineitem, t""")
def feat_9(spark, sf):
    li = table(spark, sf, "lineitem")
    return X.min_max(li, ["l_extendedprice"], li.where(li_u() >= 0.25)).select(*LK, rnd("l_extendedprice_mm").alias("p"))


@query("feat_10", "select o_orderkey, " + ", ".join(f"(o_orderpriority='{v}')::INT p{i}" for i, v in enumerate(LEVELS[:4])) + ", (o_orderstatus='P')::INT s1 from orders")
def feat_10(spark, sf):
    """Priority with an unknown level (all zeros), and a two-level status with its first level dropped."""
    o = X.one_hot(table(spark, sf, "orders"), "o_orderpriority", LEVELS[:4])
    o = X.one_hot(o, "o_orderstatus", ["F", "P"], "if_binary")
    return o.select("o_orderkey", *[F.col(f"o_orderpriority_{i}").alias(f"p{i}") for i in range(4)], F.col("o_orderstatus_1").alias("s1"))


@query("feat_11", """select o_orderkey, coalesce(list_position(['5-LOW','4-NOT SPECIFIED','3-MEDIUM','2-HIGH'], o_orderpriority),0)::INT-1 given, coalesce(list_position(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'], o_orderpriority),0)::INT-1 alphabetical from orders""")
def feat_11(spark, sf):
    order = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]
    return table(spark, sf, "orders").select("o_orderkey", X.ordinal("o_orderpriority", order).alias("given"), X.ordinal("o_orderpriority", sorted(LEVELS)).alias("alphabetical"))


@query("feat_12", "select event_id, case when value>0 and value<=10 then 'low' when value>10 and value<=50 then 'mid' when value>50 and value<=200 then 'high' end bin from events")
def feat_12(spark, sf):
    return table(spark, sf, "events").select("event_id", X.fixed_bins(F.col("value"), [0, 10, 50, 200], ["low", "mid", "high"]).alias("bin"))


@query("feat_13", f"""with e as (select quantile_cont(l_extendedprice,0.25) a, quantile_cont(l_extendedprice,0.5) b, quantile_cont(l_extendedprice,0.75) c from lineitem)
 select {K4}, ((l_extendedprice>a)::INT+(l_extendedprice>b)::INT+(l_extendedprice>c)::INT)::INT as quarter from lineitem, e""")
def feat_13(spark, sf):
    return X.quantile_bins(table(spark, sf, "lineitem"), "l_extendedprice", 4, "quarter").select(*LK, "quarter")


def _edges(lo, hi, n=6):
    return "[" + ",".join(f"{lo + (hi - lo) * i / n!r}::DOUBLE" for i in range(n + 1)) + "]"


SECTOR = f"""'R'||least(greatest(len(list_filter({_edges(40.58, 40.92)}, lambda e: e <= lat1))-1,0),5)||'C'||least(greatest(len(list_filter({_edges(-74.26, -73.75)}, lambda e: e <= lon1))-1,0),5)"""


def sectored(spark, sf):
    return with_geo(table(spark, sf, "lineitem")).withColumn("sector", X.grid_sector(F.col("lat1"), F.col("lon1"), CITY, 6))


@query("feat_14", f"select {K4}, {SECTOR} sector from {LI_GEO}")
def feat_14(spark, sf):
    return sectored(spark, sf).select(*LK, "sector")


@query("feat_15", f"select {K4}, l_tax t1, round(pow(l_tax,2),8) t2, round(pow(l_tax,3),8) t3 from lineitem")
def feat_15(spark, sf):
    p = X.powers("l_tax", 3)
    return table(spark, sf, "lineitem").select(*LK, p["l_tax_p1"].alias("t1"), rnd(p["l_tax_p2"], 8).alias("t2"), rnd(p["l_tax_p3"], 8).alias("t3"))


@query("feat_16", f"""with g as (select {SECTOR} sector, l_extendedprice y, {LI_U} >= 0.2 train from {LI_GEO}), m as (select sector, avg(y) filter (train) p, avg(y) l from g group by 1),
 j as (select g.*, coalesce(p, (select avg(y) from g where train)) p, l from g join m using (sector)), f as (select regr_slope(y,p) b, regr_intercept(y,p) a from j where train)
 select round(sqrt(avg(pow(y-(a+b*p),2))),5) rmse_proper, round(sqrt(avg(pow(y-(a+b*l),2))),5) rmse_leaky from j, f where not train""")
def feat_16(spark, sf):
    out = X.target_encoding_leak(sectored(spark, sf).select("sector", "l_extendedprice", (li_u() >= 0.2).alias("train")), "sector", "l_extendedprice", F.col("train"))
    return out.select(rnd("rmse_proper", 5).alias("rmse_proper"), rnd("rmse_leaky", 5).alias("rmse_leaky"))


@query("feat_17", " union all ".join(f"select '{c}' as \"column\", round(avg({c}),6) mean_all, round(avg({c}) filter ({LI_U} >= 0.25),6) mean_train, round(stddev_pop({c}),6) sd_all, round(stddev_pop({c}) filter ({LI_U} >= 0.25),6) sd_train from lineitem" for c in ("l_quantity", "l_discount")))
def feat_17(spark, sf):
    d = X.fit_drift(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], li_u() >= 0.25)
    return d.select("column", *[rnd(c).alias(c) for c in ("mean_all", "mean_train", "sd_all", "sd_train")])


LEAKY = "(select *, (l_returnflag='R')::INT::DOUBLE y, case when l_returnflag='R' then 1.0 else 0.0 end::DOUBLE copy, (l_returnflag='R')::INT*2+l_tax/10000 near from lineitem)"


@query("feat_18", " union all ".join(f"select '{c}' feature, round(corr({c},y),6)+0.0 r, round(avg(({c}=y)::INT),6) equal_rate, abs(corr({c},y))>=0.999 or avg(({c}=y)::INT)>=0.999 leak from {LEAKY}" for c in ("l_quantity", "copy", "near")))
def feat_18(spark, sf):
    y = (F.col("l_returnflag") == "R").cast("double")
    li = table(spark, sf, "lineitem").withColumns({"y": y, "copy": F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0), "near": y * 2 + F.col("l_tax") / 10000})
    return X.leak_screen(li, "y", ["l_quantity", "copy", "near"]).select("feature", rnd("r").alias("r"), rnd("equal_rate").alias("equal_rate"), "leak")


@query("feat_19", """select 'l_extendedprice' a, 'price_thousands' b, round(corr(l_extendedprice, round(l_extendedprice/1000,1)),6) r from lineitem
 union all select 'l_quantity' a, 'dozens' b, round(corr(l_quantity, l_quantity/12+l_tax),6) r from lineitem""")
def feat_19(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"price_thousands": F.round(F.col("l_extendedprice") / 1000, 1), "dozens": F.col("l_quantity") / 12 + F.col("l_tax")})
    return X.near_duplicates(li, ["l_extendedprice", "l_quantity", "price_thousands", "dozens"]).withColumn("r", rnd("r"))
