"""Scalar function queries."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import scalar as S
from tidegauge.operators import vectors as V
from tidegauge.operators.ordering import attach, running_sums
from tidegauge.operators.text import words
from tidegauge.plans.aggs import DEBATES, debates
from tidegauge.plans.common import LI_GEO, with_geo
from tidegauge.plans.registry import query, rnd, table

K4 = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("fn_1", f"""select {K4}, round(2*6371.0::DOUBLE*asin(sqrt(power(sin((radians(lat2)-radians(lat1))/2),2)+cos(radians(lat1))*cos(radians(lat2))*power(sin((radians(lon2)-radians(lon1))/2),2))),6) km from {LI_GEO}""")
def fn_1(spark, sf):
    g = with_geo(table(spark, sf, "lineitem"))
    return g.select(*LK, rnd(S.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).alias("km"))


@query("fn_2", """with x as (select vec_id, embedding::DOUBLE[] e from embeddings), s as (select *, list_max(e) mx, list_position(e, list_max(e))-1 am, list_sum(list_transform(e, lambda v: exp(v-list_max(e)))) t from x)
 select vec_id, am::BIGINT arg, round(1.0::DOUBLE/t,6) top_prob, round(1/(1+exp(-mx)),6) sig, round(ln((1.0::DOUBLE/t)/(1-1.0::DOUBLE/t)),6) logit from s""")
def fn_2(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    p = e.withColumn("sm", S.softmax("e")).withColumn("top", F.array_max("sm"))
    return p.select("vec_id", S.argmax("e").alias("arg"), rnd("top").alias("top_prob"), rnd(S.sigmoid(F.array_max("e"))).alias("sig"), rnd(S.logit(F.col("top"))).alias("logit"))


@query("fn_3", "select event_id, greatest(least(value,100),5) clipped, greatest(value,20) floored from events")
def fn_3(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", S.clip(v, 5.0, 100.0).alias("clipped"), S.clip(v, lo=20.0).alias("floored"))


@query("fn_4", r"select doc_id, nullif(regexp_extract(text, ',\s*([^.]+)\.', 1),'') title from documents")
def fn_4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.honorific("text").alias("title"))


@query("fn_5", f"select conv_id, turn, verdict from {DEBATES}")
def fn_5(spark, sf):
    return debates(spark, sf).select("conv_id", "turn", S.extract_verdict("said").alias("verdict"))


@query("fn_6", r"""with t as (select doc_id, list_filter(string_split_regex(text,'\s+'), lambda x: x<>'') w from documents),
 g as (select doc_id, w[i]||' '||w[i+1] g from t, unnest(range(1, len(w)::BIGINT)) r(i)),
 c as (select doc_id, g, count(*) n from g group by 1,2)
 select doc_id, count(*) grams, sum(n)::BIGINT total, max(n) top from c group by 1""")
def fn_6(spark, sf):
    # texts move once and their grams are counted where they lie: the number of parts is fixed, or they would be merged by the size of the texts
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = table(spark, sf, "documents").select("doc_id", "text").repartition(parts, "doc_id")
    d = t.select("doc_id", F.explode(S.word_ngrams(words("text"), 2)).alias("g"))
    c = d.groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("grams"), F.sum("n").alias("total"), F.max("n").alias("top"))


@query("fn_7")
def fn_7(spark, sf):
    """Each benchmark text against the next one by id (whole texts)."""
    b = table(spark, sf, "benchmark").select("item_id", words("text").alias("w"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("w2"))
    return b.join(nxt, "item_id").select("item_id", S.lcs_length(F.col("w"), F.col("w2")).alias("lcs"))


@query("fn_8", f"""select {K4}, round(l_extendedprice*100)::BIGINT cents, strftime(l_shipdate,'%Y-%m-%d') as day, false as bad_amount from lineitem""")
def fn_8(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("txt", F.concat(F.lit("  "), F.format_number("l_extendedprice", 2), F.lit(" "))).withColumn(
        "dt", F.concat(F.lit(" "), F.date_format("l_shipdate", "yyyy-MM-dd")))
    return li.select(*LK, (S.clean_amount("txt") * 100).cast("long").alias("cents"), S.iso_date("dt").cast("string").alias("day"),
                     S.clean_amount(F.concat("txt", F.lit("x"))).isNotNull().alias("bad_amount"))


@query("fn_9", """with n as (select max(ts) now from events) select event_id, ts + interval 36 hours due, ts >= now - interval 21 days in_ttl, (epoch_us(now)-epoch_us(ts))//60000000 minutes_old from events, n""")
def fn_9(spark, sf):
    e = table(spark, sf, "events")
    s = attach(e, e.agg(F.max("ts").alias("now")))
    age = F.floor((F.unix_micros(F.col("_s.now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(60000000))
    return s.select("event_id", (F.col("ts") + F.expr("interval 36 hours")).alias("due"), (F.col("ts") >= F.col("_s.now") - F.expr("interval 21 days")).alias("in_ttl"), age.alias("minutes_old"))


@query("fn_10", """with p as (select a.vec_id, a.embedding::DOUBLE[] a, b.embedding::DOUBLE[] b from embeddings a join embeddings b on b.vec_id=a.vec_id+1),
 q as (select vec_id, list_dot_product(a,b) d, sqrt(list_dot_product(a,a)) n, list_cosine_similarity(a,b) c, list_distance(a,b) e from p)
 select vec_id, round(d,6)+0.0 dot, round(n,6) norm, round(c,6)+0.0 cosine, round(e,6) euclid, true identity from q""")
def fn_10(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    ident = F.abs(F.pow(V.euclid(V.unit("embedding"), V.unit("b")), 2) - 2 * (1 - V.cosine("embedding", "b"))) < 1e-9
    return p.select("vec_id", rnd(V.dot("embedding", "b")).alias("dot"), rnd(V.norm("embedding")).alias("norm"), rnd(V.cosine("embedding", "b")).alias("cosine"),
                    rnd(V.euclid("embedding", "b")).alias("euclid"), ident.alias("identity"))


@query("fn_11", """with e as (select vec_id, embedding::DOUBLE[] v from embeddings), u as (select vec_id, list_transform(v, lambda x: x/sqrt(list_dot_product(v,v))) v from e),
 q as (select a.vec_id, list_transform(range(1,65), lambda i: a.v[i]-b.v[i]+c.v[i]) v from u a join u b on b.vec_id=a.vec_id+1 join u c on c.vec_id=a.vec_id+2)
 select q.vec_id query_id, u.vec_id answer, round(list_cosine_similarity(q.v,u.v),6) score from q, u where u.vec_id not in (q.vec_id, q.vec_id+1, q.vec_id+2)
 qualify row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v,u.v) desc, u.vec_id)=1""")
def fn_11(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.unit("embedding").alias("v"))
    shift = lambda k, n: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("v").alias(n))
    q = e.join(shift(1, "b"), "vec_id").join(shift(2, "c"), "vec_id").select("vec_id", V.analogy("v", "b", "c").alias("v"))
    # the three inputs can take at most three of the four best places
    hits = V.top_k_cosine(q, e, "vec_id", "v", 4).where(~(F.col("vec_id") - F.col("query_id")).isin(0, 1, 2))
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("query_id", F.col("vec_id").alias("answer"), rnd("score").alias("score"))


@query("fn_12", """with e as (select vec_id, embedding::DOUBLE[] v from embeddings), s as (select max(list_max(list_transform(v, lambda x: abs(x)))) sc from e),
 q as (select vec_id, v, list_transform(v, lambda x: round(x/sc*127)) c, sc from e, s)
 select vec_id, list_max(c)::INT hi, list_min(c)::INT lo, round(list_cosine_similarity(v, c),6) kept from q""")
def fn_12(spark, sf):
    q = V.quantize_int8(table(spark, sf, "embeddings"), "embedding", "code")
    code = F.transform("code", lambda x: x.cast("double"))
    return q.select("vec_id", F.array_max("code").cast("int").alias("hi"), F.array_min("code").cast("int").alias("lo"), rnd(V.cosine("embedding", code)).alias("kept"))


def boxes(spark, sf):
    """A truth box and a predicted box per line, from its keys; the image is the order, the class the line status."""
    li = table(spark, sf, "lineitem")
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    x, y = (p % 60).cast("double"), (s % 60).cast("double")
    g = F.struct(x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 40).alias("y2"))
    dx, dy = (p % 23).cast("double"), (s % 17).cast("double")
    d = F.struct((x + dx).alias("x1"), (y + dy).alias("y1"), (x + dx + 40).alias("x2"), (y + dy + 30).alias("y2"))
    return li.select(*LK, F.col("l_orderkey").alias("image"), F.col("l_linestatus").alias("cls"), g.alias("truth"), d.alias("pred"), (F.lit(1.0) - q / 60 + (p % 7).cast("double") / 1000).alias("score"))


@query("fn_13", f"""select {K4}, round(case when u>0 then w*h/u else 0 end,6) iou from (select *, 1600.0::DOUBLE+1200-w*h u from (select *,
 greatest(40.0::DOUBLE-(l_partkey%23),0) w, greatest(least(40.0::DOUBLE,(l_suppkey%17)+30)-(l_suppkey%17),0) h from lineitem))""")
def fn_13(spark, sf):
    return boxes(spark, sf).select(*LK, rnd(S.iou(F.col("truth"), F.col("pred"))).alias("iou"))


@query("fn_14", "select event_id, case when value/100<0.1 then 'stable' when value/100<0.25 then 'moderate shift' else 'significant drift' end tag from events")
def fn_14(spark, sf):
    return table(spark, sf, "events").select("event_id", S.psi_label(F.col("value") / 100).alias("tag"))


@query("fn_15", "select event_id, json_extract(props,'$.k')::INT k, props->>'$.k' raw from events")
def fn_15(spark, sf):
    e = table(spark, sf, "events").withColumn("j", F.from_json("props", "k int"))
    return e.select("event_id", "j.k", F.get_json_object("props", "$.k").alias("raw"))


STATUS = {0: "F", 1: "O", 2: "P"}  # fixed values: status codes


@query("fn_16", """select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end code, o_orderstatus as name from orders""")
def fn_16(spark, sf):
    o = table(spark, sf, "orders").withColumn("code", S.enum_code(F.col("o_orderstatus"), STATUS))
    return o.select("o_orderkey", "code", S.enum_name(F.col("code"), STATUS).alias("name"))


@query("fn_17", r"""with t as (select conv_id, turn, len(list_filter(string_split_regex(text,'\s+'), lambda x: x<>'')) n from conversations),
 c as (select *, sum(n) over (partition by conv_id order by turn desc) used from t)
 select conv_id, turn, n::INT tokens, used::BIGINT used, used <= 120 kept, least(n,40)::INT truncated, greatest(120-used,0)::BIGINT left_for_answer from c""")
def fn_17(spark, sf):
    """Newest turns first until the budget of 120 whitespace tokens is used."""
    c = table(spark, sf, "conversations").withColumn("w", words("text")).select("conv_id", "turn", F.size("w").alias("tokens"), F.size(F.slice("w", 1, 40)).alias("truncated"))
    r = running_sums(c, [-F.col("turn")], {"used": F.col("tokens").cast("long")}, ["conv_id"])
    return r.select("conv_id", "turn", "tokens", "used", (F.col("used") <= 120).alias("kept"), "truncated", F.greatest(120 - F.col("used"), F.lit(0)).alias("left_for_answer"))
