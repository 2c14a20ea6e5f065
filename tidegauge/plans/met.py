"""Metric queries."""
from pyspark.sql import functions as F

from tidegauge.functions.hashing import unit_hash
from tidegauge.operators import detection as D
from tidegauge.operators import metrics as M
from tidegauge.operators.ordering import attach
from tidegauge.plans.common import LABELLED, LI_GEO, LI_KEYS, labelled, u_sql, with_geo
from tidegauge.plans.fns import boxes
from tidegauge.plans.pred import ZONE
from tidegauge.operators.predicates import in_box
from tidegauge.plans.registry import query, rnd, table
from tidegauge.plans.tops import RANKED
from tidegauge.plans.wins import NEAR, neighbours
from tidegauge.session import settle

Y, PRED = "l_extendedprice", "(1500.0::DOUBLE*l_quantity+20000*l_discount)"


def predicted(spark, sf):
    """Lines with a fixed linear price formula as the prediction."""
    return with_geo(table(spark, sf, "lineitem")).withColumn("pred", F.lit(1500.0) * F.col("l_quantity") + 20000 * F.col("l_discount"))


def r4(df, *cols, digits=4, keep=()):
    return df.select(*keep, *[rnd(c, digits).alias(c) for c in cols])


REG = f"round(sqrt(avg(pow({Y}-{PRED},2))),4) rmse, round(avg(abs({Y}-{PRED})),4) mae, round(1-sum(pow({Y}-{PRED},2))/(var_pop({Y})*count(*)),6) r2"


@query("met_1", f"select count(*) n, round(avg(pow({Y}-{PRED},2))/1e6,4) mse_m, {REG} from lineitem")
def met_1(spark, sf):
    m = M.regression_metrics(predicted(spark, sf), Y, "pred")
    return m.select("n", rnd(F.col("mse") / 1e6, 4).alias("mse_m"), rnd("rmse", 4).alias("rmse"), rnd("mae", 4).alias("mae"), rnd("r2").alias("r2"))


@query("met_2", f"""select *, round((rmse_all-was_all)/-was_all,6) lift from (select inside, n, rmse, mae, r2, rmse_before, full_rmse rmse_all, full_before was_all from (
 select lat1 between 40.70::DOUBLE and 40.79::DOUBLE and lon1 between -74.02::DOUBLE and -73.96::DOUBLE inside, count(*) n, {REG}, round(sqrt(avg(pow({Y}-1500.0::DOUBLE*l_quantity,2))),4) rmse_before,
 sqrt(avg(pow({Y}-{PRED},2))) full_rmse, sqrt(avg(pow({Y}-1500.0::DOUBLE*l_quantity,2))) full_before from {LI_GEO} group by 1))""".replace("select *, round", "select inside, n, rmse, mae, r2, rmse_before, round"))
def met_2(spark, sf):
    """Inside and outside the zone: the model with the discount, and what that feature adds to quantity alone."""
    d = predicted(spark, sf).withColumns({"inside": in_box(F.col("lat1"), F.col("lon1"), ZONE), "plain": F.lit(1500.0) * F.col("l_quantity")})
    m = M.stage_lift(d, Y, "plain", "pred", ["inside"])
    return m.select("inside", "n", rnd("rmse", 4).alias("rmse"), rnd("mae", 4).alias("mae"), rnd("r2").alias("r2"), rnd("rmse_before", 4).alias("rmse_before"), rnd("lift").alias("lift"))


@query("met_3", f"""with d as (select {Y} y, {PRED} p from lineitem), m as (select quantile_cont(y,0.5) m from d), b as (select y y0, p p0 from d, m order by abs(y-m), y, p limit 1),
 s as (select count(*) n, sum(pow(y-p,2)) sq, sum(abs(y-p)) ab from d)
 select round(sqrt(sq/n),4) rmse, round(ab/n,4) mae, round(sqrt((sq-pow(y0-p0,2)+pow(10*y0-p0,2))/n),4) rmse_bad, round((ab-abs(y0-p0)+abs(10*y0-p0))/n,4) mae_bad from s, b""")
def met_3(spark, sf):
    return r4(M.outlier_sensitivity(predicted(spark, sf), Y, "pred"), "rmse", "mae", "rmse_bad", "mae_bad")


@query("met_4", f"""with r as (select {Y}-{PRED} v from lineitem), e as (select min(v) lo, max(v) hi from r), c as (select least(floor((v-lo)/((hi-lo)/40)),39)::INT bin, count(*) n from r, e group by 1)
 select 'bin ' || b part, null::DOUBLE fitted, null::DOUBLE actual, null::DOUBLE residual, round(lo+b*((hi-lo)/40),4) as left, coalesce(n,0)::DOUBLE n from range(40) r(b) cross join e left join c on bin=b
 union all select 'line ' || l_orderkey || ' ' || l_linenumber, round({PRED},4), {Y}, round({Y}-{PRED},4)+0.0, null, null from lineitem""")
def met_4(spark, sf):
    """Every line's fitted value, actual value (parity) and residual, and the histogram of the residuals."""
    d, empty = predicted(spark, sf), lambda t, c: F.lit(None).cast(t).alias(c)
    bins = M.residual_histogram(d, Y, "pred").select(F.concat(F.lit("bin "), "bin").alias("part"), *[empty("double", c) for c in ("fitted", "actual", "residual")], rnd("left", 4).alias("left"), F.col("n").cast("double").alias("n"))
    points = M.residual_table(d, ["l_orderkey", "l_linenumber"], Y, "pred")
    return bins.union(points.select(F.concat_ws(" ", F.lit("line"), "l_orderkey", "l_linenumber"), rnd("fitted", 4), "actual", rnd("residual", 4), empty("double", "left"), empty("double", "n")))


def judged(spark, sf):
    hard = lambda c, t: (F.col(c) >= t).cast("int")
    return labelled(spark, sf, table).withColumns({"pred": hard("p", 0.5), "pred_toxic": hard("p2", 0.28)})


JUDGED = f"(select *, (p>=0.5)::INT pred, (p2>=0.28)::INT pred_toxic from {LABELLED})"


@query("met_5", f"select a as label, b as pred, count(j.doc_id) n from (select unnest([0,1]) a) cross join (select unnest([0,1]) b) left join {JUDGED} j on j.quality=a and j.pred=b group by 1,2")
def met_5(spark, sf):
    return M.confusion(judged(spark, sf), "quality", "pred", [0, 1])


@query("met_6", f"""select round(avg((quality=pred)::INT),6) accuracy, round(sum(quality*pred)/sum(pred),6) as precision, round(sum(quality*pred)/sum(quality),6) recall, round(2*sum(quality*pred)/(sum(pred)+sum(quality)),6) f1 from {JUDGED}""")
def met_6(spark, sf):
    return r4(judged(spark, sf).agg(*M.binary_columns(F.col("quality"), F.col("pred"))), "accuracy", "precision", "recall", "f1", digits=6)


def first_neighbour(spark, sf):
    """Label of each vector and of its nearest other vector."""
    return neighbours(spark, sf, 1).select("query_id", F.col("ql").alias("label"), F.col("cl").alias("pred"))


NN1 = f"(select query_id, ql as label, cl pred from {NEAR} where rank=1)"


def class_sql(src):
    return f"""(with c as (select class, sum(t)::BIGINT support, sum(p)::BIGINT predicted, sum(tp)::BIGINT tp from (select label as class, 1 t, 0 p, (label=pred)::INT tp from {src} union all select pred, 0, 1, 0 from {src}) group by 1)
 select *, coalesce(tp/nullif(predicted,0),0) as precision, coalesce(tp/nullif(support,0),0) as recall, coalesce(2*tp/nullif(predicted+support,0),0) f1 from c)"""


def avg_sql(src):
    c = class_sql(src)
    return f"""select 'macro' as average, round(avg(precision),6) as precision, round(avg(recall),6) recall, round(avg(f1),6) f1 from {c} union all
 select 'micro', round(sum(tp)/sum(predicted),6), round(sum(tp)/sum(support),6), round(2*sum(tp)/(sum(predicted)+sum(support)),6) from {c} union all
 select 'weighted', round(sum(precision*support)/sum(support),6), round(sum(recall*support)/sum(support),6), round(sum(f1*support)/sum(support),6) from {c}"""


@query("met_7", f"select class::INT as class, support, round(precision,6) as precision, round(recall,6) recall, round(f1,6) f1 from {class_sql(NN1)}")
def met_7(spark, sf):
    c = M.per_class(first_neighbour(spark, sf), "label", "pred")
    return r4(c, "precision", "recall", "f1", digits=6, keep=("class", "support"))


@query("met_8", avg_sql(f"(select * from {NN1} where label<>8 or {u_sql('query_id')} < 0.2)"))
def met_8(spark, sf):
    rare = first_neighbour(spark, sf).where((F.col("label") != 8) | (unit_hash("query_id") < 0.2))
    return r4(M.averaged(M.per_class(rare, "label", "pred")), "precision", "recall", "f1", digits=6, keep=("average",))


@query("met_9", f"""with r as (select quality+toxic t, pred+pred_toxic p, quality*pred+toxic*pred_toxic b, (quality<>pred)::INT+(toxic<>pred_toxic)::INT w from {JUDGED})
 select round(avg(coalesce(b/nullif(p,0),0)),6) as precision, round(avg(coalesce(b/nullif(t,0),0)),6) recall, round(avg(coalesce(2*b/nullif(p+t,0),0)),6) f1, round(avg(w)/2,6) hamming, round(avg((w=0)::INT),6) exact_match, round(avg((t>1)::INT),6) several_tags from r""")
def met_9(spark, sf):
    m = M.multilabel_report(judged(spark, sf), ["quality", "toxic"], ["pred", "pred_toxic"])
    return r4(m, "precision", "recall", "f1", "hamming", "exact_match", "several_tags", digits=6)


CURVE = f"""(select p score, sum(quality) pos, count(*)-sum(quality) neg, sum(sum(quality)) over (order by p desc) tp, sum(count(*)-sum(quality)) over (order by p desc) fp, sum(sum(quality)) over () tot_p, sum(count(*)-sum(quality)) over () tot_n from {LABELLED} group by 1)"""


def curve(spark, sf):
    return M.score_curve(labelled(spark, sf, table), "quality", "p")


@query("met_10", f"select round(sum(pos*(2*(tot_n-fp)+neg))/(2*any_value(tot_p)*any_value(tot_n)),6) roc_auc from {CURVE}")
def met_10(spark, sf):
    return r4(M.roc_auc(curve(spark, sf)), "roc_auc", digits=6)


@query("met_11", f"select round(sum(pos/tot_p*tp/(tp+fp)),6) pr_auc from {CURVE}")
def met_11(spark, sf):
    return r4(M.average_precision(curve(spark, sf)), "pr_auc", digits=6)


@query("met_12", f"select score, round(fp/tot_n,6) fpr, round(tp/tot_p,6) tpr, round(tp/(tp+fp),6) as precision from {CURVE}")
def met_12(spark, sf):
    return r4(M.curve_points(curve(spark, sf)), "fpr", "tpr", "precision", digits=6, keep=("score",))


SWEEP = [round(0.10 + 0.05 * i, 2) for i in range(17)]  # fixed values: 0.10 to 0.90


@query("met_13", f"""with t as (select unnest([{','.join(f'{t}::DOUBLE' for t in SWEEP)}]) t), s as (select t, coalesce(sum(quality) filter (p>=t),0) tp, count(*) filter (p>=t) n, sum(quality) pp from t, {LABELLED} group by 1),
 f as (select t as threshold, coalesce(tp/nullif(n,0),0) pr, tp/pp re, coalesce(2*tp/nullif(n+pp,0),0) f1 from s)
 select threshold, round(pr,6) as precision, round(re,6) recall, round(f1,6) f1, threshold=(select threshold from f order by round(f1,12) desc, threshold limit 1) is_best from f""")
def met_13(spark, sf):
    return r4(M.threshold_sweep(labelled(spark, sf, table), "quality", "p", SWEEP), "precision", "recall", "f1", digits=6, keep=("threshold", "is_best"))


@query("met_14", f"select score threshold, (10*(tot_p-tp)+fp)::DOUBLE as cost, round(tp/(tp+fp),6) as precision, round(tp/tot_p,6) recall from {CURVE} order by 10*(tot_p-tp)+fp, score limit 1")
def met_14(spark, sf):
    return r4(M.cheapest_threshold(curve(spark, sf)), "precision", "recall", digits=6, keep=("threshold", F.col("cost").cast("double").alias("cost")))


@query("met_15", f"select round(avg(pow(p-quality,2)),6) brier, round(avg(quality)*(1-avg(quality)),6) brier_ref, round(1-avg(pow(p-quality,2))/(avg(quality)*(1-avg(quality))),6) skill from {LABELLED}")
def met_15(spark, sf):
    return r4(M.brier(labelled(spark, sf, table), "quality", "p"), "brier", "brier_ref", "skill", digits=6)


@query("met_16", f"""with d as (select p, quality y, least(floor(p*10),9) b from {LABELLED}), g as (select b, count(*) n, avg(p) f, avg(y) o from d group by 1), t as (select count(*) n, avg(y) o from d)
 select round(sum(g.n*pow(f-g.o,2))/any_value(t.n),6) reliability, round(sum(g.n*pow(g.o-t.o,2))/any_value(t.n),6) resolution, round(any_value(t.o*(1-t.o)),6) uncertainty,
 round(sum(g.n*pow(f-g.o,2))/any_value(t.n)-sum(g.n*pow(g.o-t.o,2))/any_value(t.n)+any_value(t.o*(1-t.o)),6) total from g, t""")
def met_16(spark, sf):
    return r4(M.murphy(labelled(spark, sf, table), "quality", "p"), "reliability", "resolution", "uncertainty", "total", digits=6)


@query("met_17", f"""with d as (select p, quality y from {LABELLED}), e as (select [{','.join(f'quantile_cont(p,{i / 10})' for i in range(1, 10))}] e from d)
 select len(list_filter(e, lambda q: q < p))::INT bin, count(*) n, round(avg(p),6) predicted, round(avg(y),6) observed from d, e group by 1""")
def met_17(spark, sf):
    return r4(M.reliability_curve(labelled(spark, sf, table), "quality", "p"), "predicted", "observed", digits=6, keep=("bin", "n"))


@query("met_18", f"""with g as (select case when {u_sql('doc_id')} < 0.5 then 'random' when lang='en' then 'english' else 'other' end split, count(*) n, avg(pow(p-quality,2)) b, avg(quality)*(1-avg(quality)) r, avg(((p>=0.5)::INT=quality)::INT) a from {LABELLED} group by 1),
 s as (select *, 1-b/r sk from g), t as (select sk bs, a ba from s where split='random')
 select split, n, round(b,6) brier, round(sk,6) skill, round(a,6) accuracy, round((bs-sk)/abs(bs)*100,4)+0.0 skill_drop_pct, round((ba-a)/ba*100,4)+0.0 accuracy_drop_pct from s, t""")
def met_18(spark, sf):
    d = labelled(spark, sf, table).withColumn("split", F.when(unit_hash("doc_id") < 0.5, "random").when(F.col("lang") == "en", "english").otherwise("other"))
    m = M.compare_splits(d, "quality", "p", "split", "random")
    return m.select("split", "n", *[rnd(c).alias(c) for c in ("brier", "skill", "accuracy")], rnd("skill_drop_pct", 4).alias("skill_drop_pct"), rnd("accuracy_drop_pct", 4).alias("accuracy_drop_pct"))


@query("met_19", f"""with e as (select event_id, value y, json_extract(props,'$.k')::DOUBLE k, user_id::DOUBLE u, row_number() over (order by event_id) rk from events),
 h as (select event_id, k sk, u su, rep, row_number() over (partition by rep order by ('0x'||substr(md5(concat_ws('|',event_id::VARCHAR,rep::VARCHAR,'42')),1,8))::BIGINT, event_id) rk from e, range(10) r(rep)),
 b as (select sqrt(avg(pow(y-(20+0.5::DOUBLE*k+0.1::DOUBLE*u),2))) r from e), j as (select e.*, sk, su, rep from e join h using (rk))
 select 'k' feature, rep::INT as repeat, round(sqrt(avg(pow(y-(20+0.5::DOUBLE*sk+0.1::DOUBLE*u),2)))-any_value(r),6) loss from j, b group by 2
 union all select 'u', rep::INT, round(sqrt(avg(pow(y-(20+0.5::DOUBLE*k+0.1::DOUBLE*su),2)))-any_value(r),6) from j, b group by 2""")
def met_19(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").alias("y"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("user_id").cast("double").alias("u"))
    score = lambda c: F.lit(20.0) + 0.5 * c["k"] + 0.1 * c["u"]
    return M.permutation_importance(e, "event_id", ["k", "u"], "y", score, 10).withColumn("loss", rnd("loss"))


TOL = [0.005, 0.01, 0.02, 0.03]  # fixed values: tolerances of the sensitivity table


@query("met_20", f"""with c as (select n//10 k, (tp/n) s from {RANKED} where n%10=0), b as (select max(s) b from c), t as (select unnest([0.005::DOUBLE,0.01::DOUBLE,0.02::DOUBLE,0.03::DOUBLE]) tol)
 select tol, min(k) elbow_k, round(arg_min(s,k),6) score_at_elbow from c, b, t where s >= b-tol group by 1""")
def met_20(spark, sf):
    from tidegauge.operators.topk import precision_lift_at
    c = precision_lift_at(labelled(spark, sf, table), "p", "doc_id", F.col("toxic") == 1, step=10).select((F.col("N") / 10).cast("long").alias("k"), "precision")
    return M.elbow(c, "k", "precision", TOL).withColumn("score_at_elbow", rnd("score_at_elbow"))


def detections(spark, sf):
    """(predictions, truths) with one id per line."""
    b = boxes(spark, sf)
    base = b.select("image", "cls", F.concat_ws("-", *LI_KEYS).alias("id"), "truth", "pred", "score")
    return base.select("image", "cls", "id", F.col("pred").alias("box"), "score"), base.select("image", "cls", "id", F.col("truth").alias("box"))


THR = [round(0.5 + 0.05 * i, 2) for i in range(10)]  # fixed values: the ten IoU thresholds


@query("met_25")
def met_25(spark, sf):
    p, t = detections(spark, sf)
    m = D.greedy_match(p, t, ["image", "cls"], [0.3, 0.5], 20.0)
    return m.groupBy("cls", "thr").agg(F.count(F.lit(1)).alias("detections"), F.sum("tp").alias("tp"))


@query("met_26")
def met_26(spark, sf):
    p, t = detections(spark, sf)
    ap = D.coco_average_precision(D.greedy_match(p, t, ["image", "cls"], THR, 20.0, wide=True), t, "cls", THR)
    return r4(D.mean_average_precision(ap, "cls"), "map_50", "map", "mar", digits=6)


@query("met_27", """with a as (select distinct l_orderkey image, l_partkey%6 x, l_suppkey%6 y from lineitem), b as (select distinct l_orderkey image, l_partkey%6 x, (l_suppkey+l_linenumber%2)%6 y from lineitem)
 select coalesce(a.image,b.image) image, round(count(*) filter (a.image is not null and b.image is not null)/count(*),6) iou from a full join b on a.image=b.image and a.x=b.x and a.y=b.y group by 1""")
def met_27(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 6).alias("x"), (F.col("l_suppkey") % 6).alias("y"))
    b = li.select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 6).alias("x"), ((F.col("l_suppkey") + F.col("l_linenumber") % 2) % 6).alias("y"))
    return r4(M.mask_iou(a, b, "image", "x", "y"), "iou", digits=6, keep=("image",))


@query("met_28")
def met_28(spark, sf):
    p, _ = detections(spark, sf)
    kept = D.suppress(p, ["image"], 0.3, 0.2, 20.0)
    return kept.groupBy("cls").agg(F.count(F.lit(1)).alias("kept"), rnd(F.avg("score")).alias("mean_score"))


def pairs(spark, sf):
    """Every document against one benchmark text."""
    b = table(spark, sf, "benchmark")
    n = b.agg(F.count(F.lit(1)).alias("n"))
    d = attach(table(spark, sf, "documents").select("doc_id", F.col("text").alias("candidate")), n)
    d = d.select("doc_id", "candidate", (F.col("doc_id") % F.col("_s.n")).alias("item_id"))
    return d.join(b.select("item_id", F.col("text").alias("reference")), "item_id")


TOK = r"list_filter(string_split_regex({},'\s+'), lambda x: x<>'')"
PAIRS = f"""(select doc_id, d.text candidate, b.text reference, {TOK.format('d.text')} c, {TOK.format('b.text')} r from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))"""
NGRAM = """(select doc_id, n, array_to_string(w[i:i+n-1],' ') gram, count(*) k from (select doc_id, c w from {p}), range(1,5) a(n), unnest(range(1, (len(w)-n+2)::BIGINT)) r(i) group by 1,2,3)"""
OVERLAP = f"""(with p as (select * from {PAIRS}), c as (select doc_id, n, array_to_string(c[i:i+n-1],' ') gram, count(*) k from p, range(1,5) a(n), unnest(range(1, (len(c)-n+2)::BIGINT)) r(i) group by 1,2,3),
 r as (select doc_id, n, array_to_string(r[i:i+n-1],' ') gram, count(*) k from p, range(1,5) a(n), unnest(range(1, (len(r)-n+2)::BIGINT)) r(i) group by 1,2,3),
 j as (select coalesce(c.doc_id,r.doc_id) doc_id, coalesce(c.n,r.n) n, coalesce(c.k,0) ck, coalesce(r.k,0) rk from c full join r on c.doc_id=r.doc_id and c.n=r.n and c.gram=r.gram)
 select doc_id, n, sum(least(ck,rk)) matched, sum(ck) cand, sum(rk) ref from j group by 1,2)"""
BLEU = f"""(with o as (select doc_id, count(*) filter (matched>0) orders, sum(ln(matched/cand)) filter (matched>0) logs from {OVERLAP} group by 1),
 s as (select doc_id, case when len(c)>len(r) then 1.0::DOUBLE when len(c)>0 then exp(1-len(r)/len(c)) else 0 end bp from {PAIRS})
 select doc_id, bp brevity_penalty, case when orders=4 then bp*exp(logs/4) else 0 end bleu from s left join o using (doc_id))"""


def rouge_sql(n):
    return f"(select doc_id, coalesce(matched/nullif(cand,0),0) as precision, coalesce(matched/nullif(ref,0),0) recall, coalesce(2*matched/nullif(cand+ref,0),0) f1 from {OVERLAP} where n={n})"


@query("met_29", f"select doc_id, round(brevity_penalty,6) brevity_penalty, round(bleu,6) bleu from {BLEU}")
def met_29(spark, sf):
    p = pairs(spark, sf)
    return r4(M.bleu(M.word_overlap(p, "doc_id"), p, "doc_id"), "brevity_penalty", "bleu", digits=6, keep=("doc_id",))


def _chr(col, al):
    return f"(select doc_id, n, gram, count(*) k from (select doc_id, replace({col},' ','') s from {PAIRS}), range(1,3) a(n), lateral (select substr(s, i::INT, n::INT) gram from unnest(range(1, (length(s)-n+2)::BIGINT)) r(i)) group by 1,2,3)"


CHRF = f"""(with c as {_chr('candidate', 'c')}, r as {_chr('reference', 'r')},
 j as (select coalesce(c.doc_id,r.doc_id) doc_id, coalesce(c.n,r.n) n, coalesce(c.k,0) ck, coalesce(r.k,0) rk from c full join r on c.doc_id=r.doc_id and c.n=r.n and c.gram=r.gram),
 o as (select doc_id, n, sum(least(ck,rk)) m, sum(ck) c, sum(rk) r from j group by 1,2), q as (select doc_id, sum(coalesce(m/nullif(c,0),0))/2 p, sum(coalesce(m/nullif(r,0),0))/2 r from o group by 1)
 select doc_id, p, r, coalesce(5*p*r/nullif(4*p+r,0),0) chrf from q)"""


@query("met_30", f"select doc_id, round(p,6) as precision, round(r,6) recall, round(chrf,6) chrf from {CHRF}")
def met_30(spark, sf):
    return r4(M.chrf(pairs(spark, sf), "doc_id"), "precision", "recall", "chrf", digits=6, keep=("doc_id",))


@query("met_31", f"select doc_id, 'rouge1' as metric, round(precision,6) as precision, round(recall,6) recall, round(f1,6) f1 from {rouge_sql(1)} union all select doc_id, 'rouge2', round(precision,6), round(recall,6), round(f1,6) from {rouge_sql(2)}")
def met_31(spark, sf):
    o = M.word_overlap(pairs(spark, sf), "doc_id", 2)
    both = M.rouge_n(o, "doc_id", 1).withColumn("metric", F.lit("rouge1")).unionByName(M.rouge_n(o, "doc_id", 2).withColumn("metric", F.lit("rouge2")))
    return r4(both, "precision", "recall", "f1", digits=6, keep=("doc_id", "metric"))


@query("met_31_lcs")
def met_31_lcs(spark, sf):
    """The longest-common-subsequence variant (no SQL twin; tested against brute force)."""
    return r4(M.rouge_l(pairs(spark, sf), "doc_id"), "precision", "recall", "f1", digits=6, keep=("doc_id", "lcs"))


@query("met_32", """with s as (select a.label pair, a.vec_id c, b.vec_id r, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) s from embeddings a join embeddings b on b.label=(a.label+1)%10),
 p as (select pair, avg(m) p from (select pair, c, max(s) m from s group by 1,2) group by 1), r as (select pair, avg(m) r from (select pair, r, max(s) m from s group by 1,2) group by 1)
 select pair, round(p,6) as precision, round(r,6) recall, round(2*p*r/(p+r),6) f1 from p join r using (pair)""")
def met_32(spark, sf):
    """Each label's vectors against those of the next label."""
    e = table(spark, sf, "embeddings")
    c = e.select("vec_id", "embedding", F.col("label").alias("pair"))
    r = e.select("vec_id", "embedding", ((F.col("label") + 9) % 10).alias("pair"))
    return r4(M.greedy_vector_match(c, r, "vec_id", "embedding", "pair"), "precision", "recall", "f1", digits=6, keep=("pair",))


@query("met_33", f"""with t as (select doc_id, unnest({TOK.format('text')}) w from documents), c as (select w, count(*) c from t group by 1), d as (select sum(c)+count(*) d from c)
 select doc_id, count(*) tokens, round(exp(-avg(ln((c+1)/d))),4) perplexity from t join c using (w), d group by 1""")
def met_33(spark, sf):
    return M.perplexity(table(spark, sf, "documents"), "doc_id", "text").withColumn("perplexity", rnd("perplexity", 4))


@query("met_34", f"""with t as (select label, count(*)-1 total from embeddings group by 1) select query_id, round(coalesce(count(*) filter (ql=cl and rank<=5)/nullif(any_value(total),0),0),6) recall, round(1.0::DOUBLE/min(rank) filter (ql=cl),6) rr from {NEAR} join t on t.label=ql group by 1""")
def met_34(spark, sf):
    e = table(spark, sf, "embeddings")
    size = e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("total"))
    total = e.select(F.col("vec_id").alias("query_id"), "label").join(size, "label").select("query_id", "total")
    out = M.recall_and_rr(neighbours(spark, sf), "query_id", "rank", F.col("ql") == F.col("cl"), total, 5)
    return r4(out, "recall", "rr", digits=6, keep=("query_id",))


@query("met_35", f"""with r as (select query_id, rank, case when ql=cl then 3 when abs(ql-cl)=1 then 1 else 0 end rel from {NEAR}), i as (select *, row_number() over (partition by query_id order by rel desc, rank) ir from r),
 d as (select query_id, sum(case when rank<=5 then (2^rel-1)/log2(rank+1) else 0 end) a, sum(case when ir<=5 then (2^rel-1)/log2(ir+1) else 0 end) b,
 sum(case when rank<=5 then rel/log2(rank+1) else 0 end) la, sum(case when ir<=5 then rel/log2(ir+1) else 0 end) lb from i group by 1)
 select query_id, round(coalesce(a/nullif(b,0),0),6) ndcg_exp, round(coalesce(la/nullif(lb,0),0),6) ndcg_linear from d""")
def met_35(spark, sf):
    gap = F.abs(F.col("ql") - F.col("cl"))
    n = settle(neighbours(spark, sf), "neighbours").withColumn("rel", F.when(gap == 0, 3).when(gap == 1, 1).otherwise(0))
    a = M.ndcg(n, "query_id", "rank", "rel", 5).select("query_id", rnd("ndcg").alias("ndcg_exp"))
    return a.join(M.ndcg(n, "query_id", "rank", "rel", 5, "linear").select("query_id", rnd("ndcg").alias("ndcg_linear")), "query_id")


@query("met_36", f"""select doc_id, 'bleu' as metric, round(bleu,6) as value from {BLEU} union all select doc_id, 'chrf', round(chrf,6) from {CHRF}
 union all select doc_id, 'rouge1', round(f1,6) from {rouge_sql(1)} union all select doc_id, 'rouge2', round(f1,6) from {rouge_sql(2)}""")
def met_36(spark, sf):
    p = pairs(spark, sf)
    o = settle(M.word_overlap(p, "doc_id"), "overlap")
    wide = M.bleu(o, p, "doc_id").select("doc_id", "bleu").join(M.chrf(p, "doc_id").select("doc_id", "chrf"), "doc_id").join(
        M.rouge_n(o, "doc_id", 1).select("doc_id", F.col("f1").alias("rouge1")), "doc_id").join(M.rouge_n(o, "doc_id", 2).select("doc_id", F.col("f1").alias("rouge2")), "doc_id", "left")
    return wide.unpivot("doc_id", ["bleu", "chrf", "rouge1", "rouge2"], "metric", "value").where("value is not null").withColumn("value", rnd("value"))
