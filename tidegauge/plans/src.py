"""Source and sink queries."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.text import chunk_words
from tidegauge.plans.common import cents
from tidegauge.plans.registry import query, table
from tidegauge.session import scratch
from tidegauge.sources import tables as S


@query("src_1", """select event_type, count(*) n, sum(round(value*100)::BIGINT)::BIGINT cents, min(ts) first_ts from events
 where ts between '2024-01-05 06:00:00' and '2024-01-20 18:00:00' group by 1""")
def src_1(spark, sf):
    path = S.write_features(table(spark, sf, "events"), scratch(spark, "events"), "ts")
    back = S.read_features(spark, path, "ts", "2024-01-05 06:00:00", "2024-01-20 18:00:00")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("value")).alias("cents"), F.min("ts").alias("first_ts"))


@query("src_2", """select o_orderstatus, o_orderpriority, count(*) n, sum(round(o_totalprice*100)::BIGINT)::BIGINT cents, max(o_totalprice) top from orders group by 1,2""")
def src_2(spark, sf):
    agg = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("cents"), F.max("o_totalprice").alias("top"))
    return S.csv_round_trip(agg, scratch(spark, "csv"))


CHUNKS = r"""(with w as (select doc_id, list_filter(string_split_regex(text,'\s+'), lambda x: x<>'') w from documents),
 s as (select doc_id, w, unnest(range(0, greatest(len(w),1)::BIGINT, 80)) st from w where len(w)>0)
 select doc_id, (st//80)::INT ordinal, array_to_string(w[st+1:st+100],' ') chunk from s where st=0 or st+20 < len(w))"""


@query("src_3", f"select doc_id, count(*) chunks, sum(length(chunk))::BIGINT chars, min(md5(chunk)) low from {CHUNKS} group by 1")
def src_3(spark, sf):
    chunks = chunk_words(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    back = S.jsonl_round_trip(chunks, scratch(spark, "chunks"))
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.min(F.md5("chunk")).alias("low"))


@query("src_4", "select vec_id, len(embedding)::INT dim, label from embeddings")
def src_4(spark, sf):
    path = scratch(spark, "vectors")
    S.checked_vectors(table(spark, sf, "embeddings"), "embedding", 64).write.parquet(path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("dim"), "label")


@query("src_5", """select c_custkey, c_name, count(o_orderkey) n_orders, coalesce(sum(round(o_totalprice*100)::BIGINT),0)::BIGINT cents
 from customer left join orders on o_custkey=c_custkey group by 1,2""")
def src_5(spark, sf):
    customer = S.declared(table(spark, sf, "customer"), T.StructType([
        T.StructField("c_custkey", T.LongType(), False), T.StructField("c_name", T.StringType(), False)]))
    orders = S.declared(table(spark, sf, "orders"), T.StructType([
        T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_custkey", T.LongType(), False),
        T.StructField("o_totalprice", T.DoubleType(), False)]))
    # orders are summed per customer before the join, so a hot customer arrives as one row
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum(cents("o_totalprice")).alias("cents"))
    return customer.join(sums, "c_custkey", "left").na.fill(0, ["n_orders", "cents"])


@query("src_6", """select 'orders' as entity, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' as columns, count(*)::DOUBLE row_count, null::VARCHAR as error from orders
 union all select 'customer', 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment', count(*)::DOUBLE, null from customer
 union all select 'invoices', null, null, 'unknown entity'""")
def src_6(spark, sf):
    return S.describe_entities({t: table(spark, sf, t) for t in ("orders", "customer")}, ["orders", "customer", "invoices"]).withColumn("row_count", F.col("row_count").cast("double"))


@query("src_7", """with inc as (select o_orderkey, o_totalprice, 0 seq from orders union all select o_orderkey, o_totalprice, 1 from orders where o_orderstatus='P'),
 stored as (select o_orderkey from orders where o_orderdate < '1996-01-01'),
 w as (select o_orderkey, min(seq) seq from inc where o_totalprice > 2000 and o_orderkey not in (select o_orderkey from stored) group by 1)
 select i.o_orderkey, i.seq, case when i.o_totalprice <= 2000 then 'rejected' when w.seq is not null then 'inserted' else 'duplicate' end status
 from inc i left join w on i.o_orderkey=w.o_orderkey and i.seq=w.seq""")
def src_7(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    store = scratch(spark, "orders-store")
    o.where("o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey", "o_totalprice").write.parquet(store)
    times = F.when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    incoming = o.select("o_orderkey", "o_totalprice", F.explode(F.sequence(F.lit(0), times - 1)).alias("seq"))
    return S.append_once(incoming, store, "o_orderkey", "seq", F.col("o_totalprice") > 2000).select("o_orderkey", "seq", "status")


@query("src_8", """select o_orderkey, o_orderstatus, string_agg(l_linenumber||':'||l_partkey||'x'||l_quantity::INT, ';' order by l_linenumber, l_partkey, l_quantity) items
 from orders left join lineitem on l_orderkey=o_orderkey group by 1,2 having count(l_partkey)>0
 union all select o_orderkey, o_orderstatus, null from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def src_8(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    nested = S.nest_children(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), li, "o_orderkey",
                             ["l_linenumber", "l_partkey", "l_quantity"], ["l_linenumber", "l_partkey", "l_quantity"])
    text = F.array_join(F.transform("items", lambda i: F.concat(
        i["l_linenumber"].cast("string"), F.lit(":"), i["l_partkey"].cast("string"), F.lit("x"), i["l_quantity"].cast("int").cast("string"))), ";")
    return nested.select("o_orderkey", "o_orderstatus", text.alias("items"))
