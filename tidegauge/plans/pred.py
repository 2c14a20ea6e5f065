"""Projection and filter queries."""
from pyspark.sql import functions as F

from tidegauge.operators import predicates as P
from tidegauge.plans.common import LI_GEO, LI_U, li_u, u_sql, with_geo
from tidegauge.functions.hashing import unit_hash
from tidegauge.plans.registry import query, table

ZONE = (40.70, 40.79, -74.02, -73.96)  # fixed values: the surcharge zone (lat, lat, lon, lon)


@query("pred_1", "select l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag from lineitem")
def pred_1(spark, sf):
    return P.drop_columns(table(spark, sf, "lineitem"), ["l_extendedprice", "l_tax", "l_shipdate", "l_linestatus", "l_partkey", "l_suppkey"])


@query("pred_2", f"""select o_orderkey, p total, c customer from (select o_orderkey,
 case when {u_sql('o_orderkey', seed=1)} < 0.1 then null else o_totalprice end p,
 case when {u_sql('o_orderkey', seed=2)} < 0.1 then null else o_custkey end c from orders) where p is not null and c is not null""")
def pred_2(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(unit_hash("o_orderkey", seed=1) >= 0.1, F.col("o_totalprice")).alias("total"),
        F.when(unit_hash("o_orderkey", seed=2) >= 0.1, F.col("o_custkey")).alias("customer"),
    )
    return P.complete_cases(o, ["total", "customer"])


@query("pred_3", """select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus='F' and o_orderpriority='1-URGENT'
 order by o_orderkey limit 100""")
def pred_3(spark, sf):
    return P.entity_query({"orders": table(spark, sf, "orders")}, "orders", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"},
                          5000, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("pred_4", "select p_partkey, p_name from part where p_name ilike '%!_%' escape '!' or p_name ilike '%D W%' escape '!'")
def pred_4(spark, sf):
    return table(spark, sf, "part").where(P.contains_text("p_name", "_") | P.contains_text("p_name", "D W")).select("p_partkey", "p_name")


RULES_SQL = f"""case when {LI_U} < 0.05 then 'missing tax' when l_discount <= 0 then 'no discount'
 when not l_quantity between 3 and 45 then 'quantity outside 3-45' when l_extendedprice > 90000 then 'price over 90000' end"""


def trip_rules():
    return [
        ("missing tax", li_u() < 0.05),
        ("no discount", F.col("l_discount") <= 0),
        ("quantity outside 3-45", ~F.col("l_quantity").between(3, 45)),
        ("price over 90000", F.col("l_extendedprice") > 90000),
    ]


@query("pred_5", f"select coalesce({RULES_SQL},'kept') as rule, count(*) n from lineitem group by 1")
def pred_5(spark, sf):
    return P.clean(table(spark, sf, "lineitem"), trip_rules())[1]


@query("pred_6", f"select l_orderkey, l_linenumber, l_partkey from {LI_GEO} where lat1 between 40.70::DOUBLE and 40.79::DOUBLE and lon1 between -74.02::DOUBLE and -73.96::DOUBLE")
def pred_6(spark, sf):
    return with_geo(table(spark, sf, "lineitem")).where(P.in_box(F.col("lat1"), F.col("lon1"), ZONE)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("pred_7", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([
 case when not l_quantity between 2 and 49 then 'quantity_bounds' end, case when length(trim(l_returnflag)) < 1 then 'blank_flag' end,
 case when not regexp_matches(strftime(l_shipdate,'%Y-%m-%d'),'^(199[0-9]|2000)-[0-9]{2}-[0-9]{2}$') then 'ship_date' end,
 case when l_extendedprice - l_extendedprice*l_discount <= 2000 then 'net_price' end], lambda x: x is not null),',') errors from lineitem""")
def pred_7(spark, sf):
    rules = {
        "quantity_bounds": ~F.col("l_quantity").between(2, 49),
        "blank_flag": F.length(F.trim("l_returnflag")) < 1,
        "ship_date": ~F.date_format("l_shipdate", "yyyy-MM-dd").rlike("^(199[0-9]|2000)-[0-9]{2}-[0-9]{2}$"),
        "net_price": F.col("l_extendedprice") - F.col("l_extendedprice") * F.col("l_discount") <= 2000,
    }
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(P.violations(rules), ",").alias("errors"))


@query("pred_8", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(round(l_quantity::DECIMAL(18,2)*unit,2) - l_extendedprice::DECIMAL(18,2)) <= 0.02 ok
 from (select *, round(l_extendedprice/l_quantity,2)::DECIMAL(18,2) unit from lineitem)""")
def pred_8(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("unit", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.line_amount_ok(F.col("l_quantity"), F.col("unit"), F.col("l_extendedprice")).alias("ok"))


@query("pred_9", """with s as (select l_orderkey o_orderkey, sum(l_extendedprice::DECIMAL(18,2)) lines_sum from lineitem group by 1),
 h as (select o_orderkey, ((round(o_totalprice*100)::BIGINT//2)*0.01)::DECIMAL(18,2) subtotal, o_totalprice::DECIMAL(18,2) total from orders)
 select h.o_orderkey, (abs(coalesce(lines_sum,0)-subtotal))::DOUBLE subtotal_gap, (abs(subtotal+subtotal-total))::DOUBLE total_gap,
 abs(coalesce(lines_sum,0)-subtotal)<=0.02 and abs(subtotal+subtotal-total)<=0.02 reconciles from h left join s using (o_orderkey)""")
def pred_9(spark, sf):
    half = (F.floor(F.round(F.col("o_totalprice") * 100).cast("long") / 2).cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")
    h = table(spark, sf, "orders").select("o_orderkey", half.alias("subtotal"), half.alias("tax"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    out = P.totals_reconcile(h, lines, "o_orderkey", "l_extendedprice", "subtotal", "tax", "total")
    return out.select("o_orderkey", F.col("subtotal_gap").cast("double").alias("subtotal_gap"), F.col("total_gap").cast("double").alias("total_gap"), "reconciles")


@query("pred_10", """with t as (select event_id, user_id||'-'||event_id||' '||event_type c from events
 union all select event_id, user_id||'-'||event_id||' 7' c from events),
 d as (select event_id, c, translate(c,' -','') s from t)
 select event_id, c as number, coalesce(regexp_full_match(s,'[0-9]+') and list_sum(list_transform(range(0,length(s)::BIGINT),
 lambda i: case when i%2=1 then (2*try_cast(substr(s,length(s)-i,1) as INT))//10+(2*try_cast(substr(s,length(s)-i,1) as INT))%10
 else try_cast(substr(s,length(s)-i,1) as INT) end))%10=0, false) valid from d""")
def pred_10(spark, sf):
    e = table(spark, sf, "events")
    base = F.concat_ws("-", "user_id", "event_id")
    both = e.select("event_id", F.explode(F.array(F.concat_ws(" ", base, "event_type"), F.concat(base, F.lit(" 7")))).alias("number"))
    return both.withColumn("valid", P.luhn_valid(F.col("number")))


@query("pred_11", """select p_partkey, p_size + length(p_brand) + 1 family_size, (p_size + length(p_brand) + 1 <= 10) is_alone,
 not ((p_size + length(p_brand) + 1 <= 10) = (p_size < 3)) contradicts from part""")
def pred_11(spark, sf):
    size = F.col("p_size") + F.length("p_brand") + 1
    return table(spark, sf, "part").select("p_partkey", size.cast("long").alias("family_size"), (size <= 10).alias("is_alone"),
                                           (~(size <= 10).eqNullSafe(F.col("p_size") < 3)).alias("contradicts"))


@query("pred_12", """with mine as (select o_custkey, max(o_orderkey) o_orderkey from orders group by 1)
 select o.o_orderkey, o.o_custkey, o_orderstatus, o_totalprice from orders o join mine using (o_custkey, o_orderkey)""")
def pred_12(spark, sf):
    """The lookup for every caller at once: each asks for their newest order number."""
    o = table(spark, sf, "orders")
    asked = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return o.join(asked, ["o_custkey", "o_orderkey"], "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
