"""Text and retrieval queries."""
from pyspark.sql import functions as F

from tidegauge.operators import aggregates as A
from tidegauge.operators import search as IVF
from tidegauge.operators import text as T
from tidegauge.operators.vectors import top_k_cosine, unit
from tidegauge.plans.aggs import DEBATES, OUTCOME, TALLY, debates
from tidegauge.plans.common import cents
from tidegauge.plans.registry import query, rnd, table
from tidegauge.plans.src import CHUNKS
from tidegauge.plans.wins import NEAR
from tidegauge.session import scratch, settle


@query("txt_1", f"select doc_id, ordinal, row_number() over (order by doc_id, ordinal)-1 chunk_id, md5(chunk) digest from {CHUNKS}")
def txt_1(spark, sf):
    c = T.chunk_words(table(spark, sf, "documents"), "doc_id", "text")
    return T.with_running_ids(c, "doc_id").select("doc_id", "ordinal", "chunk_id", F.md5("chunk").alias("digest"))


@query("txt_2", f"select query_id, vec_id, rank, round(raw,6) score from {NEAR} where rank <= 5")
def txt_2(spark, sf):
    """Unit vectors are stored once, so that a search is a product of stored columns."""
    path = scratch(spark, "unit")
    table(spark, sf, "embeddings").select("vec_id", unit("embedding").alias("u")).write.parquet(path)
    e = spark.read.parquet(path)
    return top_k_cosine(e, e, "vec_id", "u", 5, exclude_self=True).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), rnd("score").alias("score"))


@query("txt_3")
def txt_3(spark, sf):
    """Cells by the size of the table; as many are probed as 200 sampled queries need for 95 % of their exact neighbours."""
    e = table(spark, sf, "embeddings")
    model, indexed = IVF.build_cells(e, "vec_id", "embedding", None, scratch(spark, "cells"))
    sample = settle(e.orderBy(F.xxhash64("vec_id")).limit(200), "sampled-queries")
    nprobe = IVF.probes_for(model, sample, e, indexed, "vec_id", "embedding", 10, 0.95, exclude_self=True)
    approx = IVF.probe(model, e, indexed, "vec_id", "embedding", 10, nprobe, exclude_self=True)
    exact = top_k_cosine(e, e, "vec_id", "embedding", 10, exclude_self=True)
    return IVF.recall_against(exact, approx, "vec_id").select("query_id", rnd("recall").alias("recall"))


def hits3(spark, sf):
    """Three nearest documents of every vector's document, with text and label."""
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    h = top_k_cosine(e, e, "vec_id", "embedding", 3, exclude_self=True)
    return h.join(e.select("vec_id", "label"), "vec_id").join(d, "vec_id")


_PROMPT = "'" + T.PROMPT.replace("'", "''").replace("{context}", "'||context||'").replace("{question}", "'||'Which passages resemble document '||query_id||'?'||'") + "'"


@query("txt_4", f"""with h as (select query_id, rank, vec_id, cl, raw, text from {NEAR} join documents on doc_id=vec_id where rank <= 3),
 c as (select query_id, string_agg('[chunk '||vec_id||', page '||cl||', similarity '||printf('%.4f',raw)||']'||chr(10)||text, chr(10)||chr(10) order by rank) context from h group by 1)
 select query_id, md5(context) digest, length(context) chars, md5({_PROMPT}) prompt_digest from c""")
def txt_4(spark, sf):
    c = T.assemble_context(hits3(spark, sf), "query_id", "rank", "vec_id", "label", "score", "text")
    asked = T.prompt(F.col("context"), F.concat(F.lit("Which passages resemble document "), F.col("query_id").cast("string"), F.lit("?")))
    return c.select("query_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("chars"), F.md5(asked).alias("prompt_digest"))


@query("txt_5")
def txt_5(spark, sf):
    learned = T.learn_merges(T.word_counts(table(spark, sf, "documents"), "text"), 8)
    return spark.createDataFrame([(i, a, b, n) for i, (a, b, n) in enumerate(learned, 1)], "step int, a string, b string, n long")


@query("txt_6")
def txt_6(spark, sf):
    """Merges learned on the documents, applied to every word of the conversations."""
    learned = [(a, b) for a, b, _ in T.learn_merges(T.word_counts(table(spark, sf, "documents"), "text"), 8)]
    w = T.word_counts(table(spark, sf, "conversations"), "text")
    return w.select("word", "freq", F.array_join(T.apply_merges("word", learned), " ").alias("pieces"))


def invoices(spark, sf):
    """One invoice text per order, laid out from the order and its lines (orders without lines lack the table; some lack the tax line)."""
    money = lambda c: F.format_number((c / 100).cast("decimal(18,2)"), 2)
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity", cents("l_extendedprice").alias("c"))
    line = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "),
                    money(F.floor(F.col("c") / F.col("l_quantity"))), F.lit(" "), money(F.col("c")))
    rows = li.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "c", line.alias("s")))).alias("rows"), F.sum("c").alias("sub"))
    # by shuffle at any size: the texts are built and read where the join puts them, and one file of orders would be one task
    o = table(spark, sf, "orders").join(rows.hint("merge"), "o_orderkey", "left").withColumn("sub", F.coalesce("sub", F.lit(0)))
    tax = F.floor(F.col("sub") / 10)
    parts = [F.lit("Acme Trading"), F.concat(F.lit(" Street "), F.col("o_custkey").cast("string")), F.concat(F.lit("Invoice Number: INV-"), F.col("o_orderkey").cast("string")),
             F.concat(F.lit("Invoice Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("Bill To: Customer "), F.col("o_custkey").cast("string")), F.lit(T.ITEM_HEADER),
             F.when(F.col("rows").isNotNull(), F.concat(F.lit("-----\n"), F.array_join(F.col("rows.s"), "\n"), F.lit("\n-----"))), F.concat(F.lit("Subtotal: "), money(F.col("sub"))),
             F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("Tax (10%): "), money(tax))), F.concat(F.lit("Total Due: "), money(F.col("sub") + tax))]
    return o.select(F.col("o_orderkey").alias("doc"), F.concat_ws("\n", *parts).alias("text"))


@query("txt_7", """with l as (select l_orderkey, count(*) n, sum(round(l_extendedprice*100)::BIGINT)::BIGINT sub, sum(l_quantity)::BIGINT q from lineitem group by 1)
 select o_orderkey, 'INV-'||o_orderkey invoice_number, strftime(o_orderdate,'%Y-%m-%d') invoice_date, 'Customer '||o_custkey bill_to, coalesce(sub,0)/100.0::DOUBLE subtotal,
 (coalesce(sub,0)+coalesce(sub,0)//10)/100.0::DOUBLE total, coalesce(n,0) n_items, coalesce(q,0) quantity, coalesce(sub,0)/100.0::DOUBLE items_sum,
 concat_ws(',', case when o_orderpriority='5-LOW' then 'missing tax' end, case when n is null then 'missing line_items' end) errors from orders left join l on l_orderkey=o_orderkey""")
def txt_7(spark, sf):
    out = T.parse_documents(invoices(spark, sf), "doc", "text").withColumn("o_orderkey", F.col("doc"))
    quantity = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["quantity"])
    amount = F.aggregate("items", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["amount"]).cast("decimal(28,2)"))
    return out.select("o_orderkey", "invoice_number", "invoice_date", "bill_to", F.col("subtotal").cast("double").alias("subtotal"), F.col("total").cast("double").alias("total"),
                      F.col("n_items").cast("long").alias("n_items"), quantity.alias("quantity"), amount.cast("double").alias("items_sum"), F.array_join("errors", ",").alias("errors"))


@query("txt_9", f"""with d as (select * from {DEBATES}), o as (select * from {OUTCOME}), t as (select * from {TALLY}), l as (select * from d qualify row_number() over (partition by conv_id, role order by turn desc)=1)
 select conv_id, 0 section, 0 seq, 'Rounds run: '||rounds_run||' (stop reason: '||stop_reason||')' line from o union all select conv_id, 1, turn, '[Round '||round_no||'] '||role||': '||said from d
 union all select conv_id, 2, turn, '  '||role||': '||coalesce(verdict,'ABSTAIN') from l
 union all select conv_id, 3, 0, 'Unanimous: '||case when unanimous then 'True' else 'False' end||'   Deadlock: '||case when deadlock then 'True' else 'False' end||'   Winning verdict: '||coalesce(t.winner,'None') from o join t using (conv_id)""")
def txt_9(spark, sf):
    d = debates(spark, sf)
    o = A.debate_outcome(d, "conv_id", "role", "round_no", "verdict")
    t = A.tally(d, "conv_id", "role", "turn", "verdict")
    return T.report_lines(d, o, t, "conv_id", "role", "round_no", "turn", "said", "verdict")


@query("txt_10", f"select query_id, rank, vec_id, round(raw,4) score, text[1:70]||case when length(text)>70 then '...' else '' end snippet from {NEAR} join documents on doc_id=vec_id where rank <= 3")
def txt_10(spark, sf):
    return hits3(spark, sf).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", rnd("score", 4).alias("score"), T.snippet("text").alias("snippet"))
