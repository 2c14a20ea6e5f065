"""Top-k and set queries."""
from pyspark.sql import functions as F

from tidegauge.operators import predicates as P
from tidegauge.operators import topk as K
from tidegauge.operators.vectors import top_k_cosine
from tidegauge.plans.common import LABELLED, cents, labelled
from tidegauge.plans.registry import query, rnd, table
from tidegauge.plans.wins import NEAR


@query("top_1", "select s_suppkey, s_name, round(s_acctbal-4500,2) gap from supplier")
def top_1(spark, sf):
    s = table(spark, sf, "supplier").withColumn("gap", rnd(F.col("s_acctbal") - 4500, 2))
    return K.by_size(s, "gap", "s_suppkey").select("s_suppkey", "s_name", "gap")


@query("top_2", f"select query_id, vec_id, rank, round(raw,6) score from {NEAR} where rank <= 3")
def top_2(spark, sf):
    e = table(spark, sf, "embeddings")
    return top_k_cosine(e, e, "vec_id", "embedding", 3, exclude_self=True).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), rnd("score").alias("score"))


RANKED = f"(select row_number() over w n, (sum(toxic) over w)::BIGINT tp from {LABELLED} window w as (order by p desc, doc_id rows unbounded preceding))"


@query("top_3", f"""select n as "N", tp, round(tp/n,6) as precision, round((tp/n)/(select avg(toxic) from labels),6) lift from {RANKED} where n in (50,100,200,500,1000) or n%10=0""")
def top_3(spark, sf):
    d = labelled(spark, sf, table)
    y = F.col("toxic") == 1
    out = K.precision_lift_at(d, "p", "doc_id", y, step=10)
    return out.select("N", "tp", rnd("precision").alias("precision"), rnd("lift").alias("lift"))


@query("top_4", "select p_brand, p_partkey, p_retailprice from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey)=1")
def top_4(spark, sf):
    return K.best_rows(table(spark, sf, "part"), "p_brand", "p_retailprice", ["p_partkey", "p_retailprice"], "p_partkey")


@query("top_5", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_5(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(P.clamp_limit(500)).select("o_orderkey", "o_totalprice")


@query("top_6", """select q.vec_id query_id, c.vec_id, round(1-list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]),6)+0.0 distance from embeddings q, embeddings c
 qualify row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) desc, c.vec_id) <= 5""")
def top_6(spark, sf):
    e = table(spark, sf, "embeddings")
    return K.nearest_by_distance(e, e, "vec_id", "embedding", 5).select("query_id", "vec_id", rnd("distance").alias("distance"))


@query("top_7", """with s as (select p_brand, sum(l_quantity)::BIGINT q, sum(round(l_extendedprice*100)::BIGINT)::BIGINT c from lineitem join part on p_partkey=l_partkey group by 1)
 select p_brand from (select p_brand from s order by q desc, p_brand limit 10) where p_brand in (select p_brand from s order by c desc, p_brand limit 10)""")
def top_7(spark, sf):
    s = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("p_brand").agg(
        F.sum("l_quantity").alias("q"), F.sum(cents("l_extendedprice")).alias("c"))
    return K.top_overlap(s, s, "p_brand", F.col("q"), F.col("c"), 10)


@query("set_1", """select 'all' stream, event_type, count(*) n, round(avg(value),6) mean from events group by 2
 union all select 'high', event_type, count(*), round(avg(value),6) from events where value > 100 group by 2""")
def set_1(spark, sf):
    e = table(spark, sf, "events")
    part = lambda d, n: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("mean")).withColumn("stream", F.lit(n))
    return K.stack(part(e, "all"), part(e.where("value > 100"), "high"))


@query("set_2", "select c_custkey from customer where c_acctbal > 0 intersect select o_custkey from orders where o_orderstatus='F'")
def set_2(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey").intersect(
        table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query("set_3", "select o_orderkey from orders except select l_orderkey from lineitem")
def set_3(spark, sf):
    """Orders not scored yet: a left anti join, since order keys are unique."""
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("set_4", """with s as (select p_partkey, p_size, p_retailprice, p_type from part),
 v as (select p_partkey, 'size' m from s where p_size > 40 union all select p_partkey, 'price' from s where p_retailprice > 1000 union all select p_partkey, 'type' from s where p_type='SMALL')
 select p_partkey, max((m='price')::INT) price, max((m='size')::INT) as size, max((m='type')::INT) as type, count(*)::INT votes from v group by 1""")
def set_4(spark, sf):
    p = table(spark, sf, "part")
    pick = lambda cond, m: p.where(cond).select("p_partkey", F.lit(m).alias("method"))
    sel = K.stack(pick("p_size > 40", "size"), pick("p_retailprice > 1000", "price"), pick("p_type = 'SMALL'", "type"))
    return K.votes(sel, "p_partkey", "method", ["price", "size", "type"])
