"""Model queries. Most have no SQL twin, since solvers differ; tests check their invariants."""
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidegauge.functions.hashing import unit_hash
from tidegauge.operators import metrics as MT
from tidegauge.operators import ml as M
from tidegauge.operators import splits as S
from tidegauge.operators.boosting import boosted_probability, fit_boosted
from tidegauge.operators.leak import selection_leak
from tidegauge.operators.ordering import attach
from tidegauge.operators.unit_root import augmented_dickey_fuller
from tidegauge.plans.common import LABELLED, LI_KEYS, labelled, li_u, monthly, u_sql
from tidegauge.plans.registry import query, rnd, table
from tidegauge.plans.wins import NEAR, neighbours
from tidegauge.session import scratch, settle

K4 = ", ".join(LI_KEYS)
NUM = ["l_quantity", "l_discount", "l_tax"]


def lines(spark, sf):
    """Lines with a hashed fold number and some gaps in the tax column."""
    li = table(spark, sf, "lineitem").withColumn("u", li_u())
    return li.withColumn("gap_tax", F.when(li_u(5) >= 0.1, F.col("l_tax")))


def docs(spark, sf):
    """Labelled documents with numeric features."""
    d = labelled(spark, sf, table)
    return d.withColumns({"log_n": F.log("n_chars"), "is_en": (F.col("lang") == "en").cast("double"), "h": unit_hash("doc_id", seed=77), "u": unit_hash("doc_id")})


DOC_FEATS = ["log_n", "is_en", "h"]


@query("ml_1")
def ml_1(spark, sf):
    d = lines(spark, sf)
    train = d.where("u >= 0.25")
    d = M.impute_all(d, ["gap_tax"], train)
    model = M.fit_pipeline(d.where("u >= 0.25"), ["l_quantity", "l_discount", "gap_tax"], ["l_returnflag", "l_linestatus"], M.LinearRegression(labelCol="l_extendedprice"))
    out = model.transform(d.where("u < 0.25"))
    return out.select(*LI_KEYS, rnd("prediction", 2).alias("prediction"))


@query("ml_2", "select '(intercept)' term, round(regr_intercept(l_extendedprice,l_quantity),3) coef from lineitem union all select 'l_quantity', round(regr_slope(l_extendedprice,l_quantity),3) from lineitem")
def ml_2(spark, sf):
    m = M.linear(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return M.coefficient_table(m, ["l_quantity"], spark).withColumn("coef", rnd("coef", 3))


@query("ml_3")
def ml_3(spark, sf):
    m = M.RandomForestRegressor(labelCol="l_extendedprice", numTrees=10, maxDepth=5, seed=42).fit(M.assembled(table(spark, sf, "lineitem"), NUM))
    return M.importance_table(m, NUM, spark)


@query("ml_4")
def ml_4(spark, sf):
    """Boosting with default and with tuned settings, train and test error side by side."""
    d = settle(M.assembled(lines(spark, sf).select("u", "l_extendedprice", *NUM), NUM).withColumn("part", F.when(F.col("u") < 0.25, "test").otherwise("train")), "boost")
    out = None
    for name, kw in (("default", {"maxIter": 10, "maxDepth": 5}), ("tuned", {"maxIter": 10, "maxDepth": 3, "stepSize": 0.3})):
        m = M.GBTRegressor(labelCol="l_extendedprice", seed=42, **kw).fit(d.where("part = 'train'"))
        r = MT.regression_metrics(m.transform(d), "l_extendedprice", "prediction", ["part"]).withColumn("settings", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out.select("settings", "part", "n", rnd("rmse", 2).alias("rmse"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), unit_hash("vec_id").alias("u"))


@query("ml_5")
def ml_5(spark, sf):
    v = vectors(spark, sf)
    def held_out(d, family):
        p = M.LogisticRegression(family="auto", regParam=0.01, maxIter=50).fit(d.where("u >= 0.25")).transform(d.where("u < 0.25"))
        return p.agg(F.lit(family).alias("family"), F.count(F.lit(1)).alias("n"), rnd(F.avg((F.col("prediction") == F.col("label")).cast("double"))).alias("accuracy"))

    return held_out(v, "multinomial").union(held_out(v.withColumn("label", (F.col("label") == 0).cast("double")), "binary"))


@query("ml_6")
def ml_6(spark, sf):
    v = vectors(spark, sf)
    m = M.OneVsRest(classifier=M.LogisticRegression(regParam=0.01, maxIter=20), parallelism=4).fit(v.where("u >= 0.25"))
    return m.transform(v.where("u < 0.25")).select("vec_id", "label", "prediction")


@query("ml_7")
def ml_7(spark, sf):
    """One model per tag over one assembled, settled table."""
    d = settle(M.assembled(docs(spark, sf), DOC_FEATS).select("doc_id", "quality", "toxic", *DOC_FEATS, "features"), "tags")
    out = d.drop("features")
    for tag in ("quality", "toxic"):
        m = M.LogisticRegression(labelCol=tag, maxIter=20).fit(d)
        out = M.scored(m, out, DOC_FEATS, None).withColumn(f"pred_{tag}", F.col("prediction").cast("int")).drop("prediction")
    return out.select("doc_id", "quality", "toxic", "pred_quality", "pred_toxic")


@query("ml_8", "select doc_id, toxic, round(count(*) over () / (2 * count(*) over (partition by toxic)),6) weight, 1 fitted from labels")
def ml_8(spark, sf):
    d = M.class_weights(docs(spark, sf), "toxic")
    m = M.DecisionTreeClassifier(labelCol="toxic", weightCol="weight", maxDepth=4, seed=42).fit(M.assembled(d, DOC_FEATS))
    return m.transform(M.assembled(d, DOC_FEATS)).select("doc_id", "toxic", rnd("weight").alias("weight"), F.when(F.col("prediction").isin(0.0, 1.0), 1).otherwise(0).alias("fitted"))


@query("ml_9", f"""with t as (select * from labels where {u_sql('doc_id')} >= 0.25), b as (select (select quality from t group by 1 order by count(*) desc, 1 limit 1) majority, avg(quality) mean from t)
 select majority, round(any_value(mean),6) mean, round(avg((quality=majority)::INT),6) accuracy, round(sqrt(avg(pow(quality-mean,2))),6) rmse from labels, b where {u_sql('doc_id')} < 0.25 group by 1""")
def ml_9(spark, sf):
    d = table(spark, sf, "labels").withColumn("u", unit_hash("doc_id"))
    s = attach(d.where("u < 0.25"), M.majority_baseline(d.where("u >= 0.25"), "quality"))
    return s.groupBy("_s.majority").agg(rnd(F.max("_s.mean")).alias("mean"), rnd(F.avg((F.col("quality") == F.col("_s.majority")).cast("double"))).alias("accuracy"), rnd(F.sqrt(F.avg(F.pow(F.col("quality") - F.col("_s.mean"), 2)))).alias("rmse"))


@query("ml_10")
def ml_10(spark, sf):
    """Lasso and L1-logistic selection: which features keep a coefficient."""
    li = settle(M.assembled(lines(spark, sf).withColumn("dear", (F.col("l_extendedprice") > 40000).cast("double")), [*NUM, "u"]).select("features", "l_extendedprice", "dear"), "lasso")
    a = M.LinearRegression(labelCol="l_extendedprice", regParam=500.0, elasticNetParam=1.0).fit(li)
    b = M.LogisticRegression(labelCol="dear", regParam=0.02, elasticNetParam=1.0).fit(li)
    rows = [(f, bool(abs(x) > 1e-9), bool(abs(y) > 1e-9)) for f, x, y in zip([*NUM, "u"], a.coefficients, b.coefficients)]
    return spark.createDataFrame(rows, "feature string, lasso boolean, l1_logistic boolean")


NEAR_15 = NEAR.replace("rank <= 10", "rank <= 15")


@query("ml_11", f"""with n as (select k, query_id, cl from {NEAR_15}, (values (1), (15)) t(k) where rank <= k), v as (select k, query_id, cl, count(*) c from n group by all),
 p as (select k, query_id, cl pred from v qualify row_number() over (partition by k, query_id order by c desc, cl)=1), a as (select k, query_id, avg(cl) mean from n group by all)
 select k, p.query_id, label, pred, round(mean,6) mean from p join embeddings on vec_id=query_id join a using (k, query_id)""")
def ml_11(spark, sf):
    """Vote (ties to the smaller class) and mean of the 15 nearest other vectors, and of the nearest one."""
    n = neighbours(spark, sf, 15).withColumn("k", F.explode(F.when(F.col("rank") == 1, F.array(F.lit(1), F.lit(15))).otherwise(F.array(F.lit(15)))))
    votes = n.groupBy("k", "query_id", "ql", "cl").agg(F.count(F.lit(1)).alias("c"))
    pred = votes.groupBy("k", "query_id", "ql").agg(F.max_by("cl", F.struct("c", -F.col("cl"))).alias("pred"), (F.sum(F.col("cl") * F.col("c")) / F.sum("c")).alias("mean"))
    return pred.select("k", "query_id", F.col("ql").alias("label"), "pred", rnd("mean").alias("mean"))


def slices(spark, sf):
    d = settle(docs(spark, sf), "scored")
    return d.where("u < 0.5"), d.where("u >= 0.5")


_CAL = f"(select *, {u_sql('doc_id')} u from {LABELLED})"


# the fit at a score is the largest over all beginnings of the least over all ends of the mean between them
@query("ml_12", f"""with g as (select p x, sum(quality)::DOUBLE s, count(*)::DOUBLE w from {_CAL} where u < 0.5 group by 1),
 k as (select x, sum(s) over (order by x) s1, sum(w) over (order by x) w1, sum(s) over (order by x) - s s0, sum(w) over (order by x) - w w0 from g),
 m as (select a.x a, i.x i, min((c.s1-a.s0)/(c.w1-a.w0)) v from k a join k i on a.x <= i.x join k c on c.x >= i.x group by 1, 2), v as (select i x, max(v) v from m group by 1),
 t as (select doc_id, p, (select max(x) from v where x <= p) x0, (select min(x) from v where x >= p) x1 from {_CAL} where u >= 0.5)
 select doc_id, p, round(case when x0 is null then b.v when x1 is null or x0 = x1 then a.v else a.v + (b.v-a.v)*(p-x0)/(x1-x0) end, 6)+0.0 calibrated from t left join v a on a.x = x0 left join v b on b.x = x1""")
def ml_12(spark, sf):
    cal, test = slices(spark, sf)
    return M.isotonic(cal, test, "p", "quality").select("doc_id", "p", rnd("calibrated").alias("calibrated"))


@query("ml_13")
def ml_13(spark, sf):
    cal, test = slices(spark, sf)
    return M.platt(cal, test, "p", "quality").select("doc_id", "p", rnd("calibrated").alias("calibrated"))


@query("ml_14")
def ml_14(spark, sf):
    cal, test = slices(spark, sf)
    under = S.undersample(cal, "doc_id", "toxic")
    out = M.cross_calibrated(under, test, "doc_id", ["log_n", "is_en"], "toxic")
    return out.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("calibrated")).alias("mean_calibrated"), rnd(F.avg("toxic")).alias("true_rate"))


@query("ml_15", f"""with r as (select avg(toxic) t from labels) select doc_id, p2, round(1/(1+exp(-(ln(p2/(1-p2))+ln(t/(1-t))-ln(0.5::DOUBLE/0.5::DOUBLE)))),6) corrected from {LABELLED}, r""")
def ml_15(spark, sf):
    d = labelled(spark, sf, table)
    s = attach(d, d.agg(F.avg("toxic").alias("t")))
    return s.select("doc_id", "p2", rnd(M.prior_corrected(F.col("p2"), F.col("_s.t"), F.lit(0.5))).alias("corrected"))


@query("ml_16")
def ml_16(spark, sf):
    """Balanced bagging of 25 trees, and the easy ensemble: 25 bags of boosted stumps, 50 rounds."""
    cal, test = slices(spark, sf)
    a = M.bagged_probability(cal, test, "doc_id", DOC_FEATS, "toxic", 25, lambda: M.DecisionTreeClassifier(maxDepth=3, seed=42)).withColumnRenamed("prob", "bagging")
    b = boosted_probability(a, fit_boosted(cal, "doc_id", DOC_FEATS, "toxic"))
    return b.select("doc_id", "toxic", rnd("bagging").alias("bagging"), rnd("prob").alias("boosted"))


@query("ml_17")
def ml_17(spark, sf):
    """Accuracy of each stratified fold, with the mean and the standard deviation over the folds."""
    cv = M.cross_validated(docs(spark, sf), "doc_id", DOC_FEATS, "quality", lambda: M.LogisticRegression(maxIter=10))
    total = cv.agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("sd"))
    return attach(cv, total).select("fold", "n", rnd("accuracy").alias("accuracy"), rnd("_s.mean").alias("mean"), rnd("_s.sd").alias("sd"))


@query("ml_17_folds", f"with f as (select quality, ((row_number() over (partition by quality order by ('0x'||substr(md5(concat_ws('|',doc_id::VARCHAR,'42')),1,8))::BIGINT, doc_id)-1)%5)::INT fold from labels) select fold, count(*) n, sum(quality)::BIGINT good from f group by 1")
def ml_17_folds(spark, sf):
    """The folds themselves: rows and positives of each."""
    return S.stratified_folds(docs(spark, sf), "doc_id", "quality").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query("ml_18")
def ml_18(spark, sf):
    d = lines(spark, sf)
    return M.random_search(d, NUM, "l_extendedprice", F.col("u"), {"maxDepth": [2, 3, 4], "numTrees": [3, 5]}, 6, lambda **kw: M.RandomForestRegressor(seed=42, **kw), 3).withColumn("rmse", rnd("rmse", 2))


@query("ml_19")
def ml_19(spark, sf):
    cal, test = slices(spark, sf)
    fam = {"logistic": lambda: M.LogisticRegression(maxIter=10), "tree": lambda: M.DecisionTreeClassifier(maxDepth=3, seed=42), "forest": lambda: M.RandomForestClassifier(numTrees=5, maxDepth=3, seed=42)}
    return M.family_search(cal, test, DOC_FEATS, "quality", fam).select("place", "family", rnd("log_loss").alias("log_loss"))


LAG_SETS = {"1": [1], "1,2,3": [1, 2, 3], "1,12": [1, 12], "1,2,12": [1, 2, 12]}


@query("ml_20")
def ml_20(spark, sf):
    """Backtest error of each lag set per series, and the set that wins (ties: first by name)."""
    m = settle(monthly(table(spark, sf, "orders")), "monthly")
    out = None
    for name, lags in LAG_SETS.items():
        b = M.lag_backtest(m, "series", "m", "y", lags).withColumn("lags", F.lit(name))
        out = b if out is None else out.unionByName(b)
    mean = settle(out.groupBy("series", "lags").agg(F.avg("rmse").alias("mean_rmse"), F.count(F.lit(1)).alias("folds")), "lag-sets")
    best = mean.groupBy("series").agg(F.min(F.struct("mean_rmse", "lags")).alias("b"))
    return mean.join(best, "series").select("series", "lags", "folds", rnd("mean_rmse", 2).alias("mean_rmse"), (F.col("lags") == F.col("b.lags")).alias("picked"))


@query("ml_21")
def ml_21(spark, sf):
    m = settle(monthly(table(spark, sf, "orders")), "monthly")
    a = M.lag_backtest(m, "series", "m", "y", [1, 12]).withColumn("model", F.lit("seasonal AR"))
    b = M.lag_backtest(m, "series", "m", "y", [1], trend=2).withColumn("model", F.lit("quadratic trend + AR(1)"))
    return a.unionByName(b).groupBy("model", "series").agg(rnd(F.avg("rmse"), 2).alias("mean_rmse"))


@query("ml_22")
def ml_22(spark, sf):
    m = settle(monthly(table(spark, sf, "orders")), "monthly")
    adf = augmented_dickey_fuller(m, "series", "m", "y").select("series", rnd("stat", 4).alias("adf"), rnd("p").alias("adf_p"), "stationary", F.when(F.col("stationary"), 0).otherwise(1).alias("differencing"))
    mean = lambda d, n: d.groupBy("series").agg(rnd(F.avg("rmse"), 2).alias(n))
    t = adf.join(mean(M.lag_backtest(m, "series", "m", "y", [1, 2, 12]), "lag_rmse"), "series").join(mean(M.lag_backtest(m, "series", "m", "y", [1], trend=2), "ar_rmse"), "series")
    return t.withColumn("winner", F.when(F.col("lag_rmse") <= F.col("ar_rmse"), "lag regression").otherwise("trend + AR"))


@query("ml_23")
def ml_23(spark, sf):
    """Train and validation RMSE by polynomial degree, in the Chebyshev basis (powers are too close to collinear); the degrees are a short driver loop."""
    x = F.acos(F.least(F.greatest(F.col("l_quantity") / 25 - 1, F.lit(-1.0)), F.lit(1.0)))
    d = settle(lines(spark, sf).select("u", "l_extendedprice", *[F.cos(x * i).alias(f"x{i}") for i in range(1, 16)]), "polynomials")
    out = None
    for deg in range(1, 16):
        feats = [f"x{i}" for i in range(1, deg + 1)]
        m = M.linear(d.where("u >= 0.3"), feats, "l_extendedprice")
        e = d.withColumn("p", M.linear_expression(m, feats)).groupBy((F.col("u") < 0.3).alias("validation")).agg(rnd(F.sqrt(F.avg(F.pow(F.col("l_extendedprice") - F.col("p"), 2))), 3).alias("rmse")).withColumn("degree", F.lit(deg))
        out = e if out is None else out.unionByName(e)
    return out


@query("ml_24")
def ml_24(spark, sf):
    """Clusters and the two-dimensional projection of the vectors."""
    v = vectors(spark, sf)
    pca = M.PCA(k=2, inputCol="features", outputCol="pc").fit(v)
    share = float(sum(pca.explainedVariance))
    c = M.KMeans(k=10, seed=42, maxIter=10).fit(v)
    p = c.transform(pca.transform(v)).withColumn("pc", vector_to_array("pc"))
    return p.select("vec_id", F.col("prediction").alias("cluster"), rnd(F.abs(F.col("pc")[0]), 4).alias("pc1"), rnd(F.abs(F.col("pc")[1]), 4).alias("pc2"), rnd(F.lit(share)).alias("explained"))


@query("ml_24_als")
def ml_24_als(spark, sf):
    """Factorisation of the customer by brand quantities."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("item")
    r = settle(li.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), brand), "l_partkey").groupBy(F.col("o_custkey").cast("int").alias("user"), "item").agg(F.sum("l_quantity").cast("float").alias("rating")), "ratings")
    m = M.ALS(rank=4, maxIter=5, seed=42, userCol="user", itemCol="item", ratingCol="rating").fit(r)
    return m.transform(r).agg(F.count(F.lit(1)).alias("n"), rnd(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))), 2).alias("rmse"))


def sql_model(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("tg_lines")
    return M.train_model(spark, "SELECT l_quantity, l_extendedprice FROM tg_lines", "l_extendedprice", "linear_reg", {"solver": "normal"})


@query("ml_25")
def ml_25(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("tg_lines")
    m = M.train_model(spark, "SELECT l_quantity, l_discount, l_returnflag, l_extendedprice FROM tg_lines", "l_extendedprice", "linear_reg")
    last = m.stages[-1]
    return spark.createDataFrame([("linear_reg", len(last.coefficients), float(last.intercept))], "model_type string, features int, intercept double").withColumn("intercept", rnd("intercept", 2))


LINE = "(select regr_slope(l_extendedprice,l_quantity) b, regr_intercept(l_extendedprice,l_quantity) a from lineitem)"


@query("ml_26", f"select count(*) n, round(sqrt(avg(pow(l_extendedprice-(a+b*l_quantity),2))),3) rmse, round(avg(abs(l_extendedprice-(a+b*l_quantity))),3) mae, round(1-sum(pow(l_extendedprice-(a+b*l_quantity),2))/(var_pop(l_extendedprice)*count(*)),6) r2 from lineitem, {LINE} where l_returnflag='R'")
def ml_26(spark, sf):
    e = M.evaluate(sql_model(spark, sf), spark.sql("SELECT l_quantity, l_extendedprice FROM tg_lines WHERE l_returnflag = 'R'"), "l_extendedprice")
    return e.select("n", rnd("rmse", 3).alias("rmse"), rnd("mae", 3).alias("mae"), rnd("r2").alias("r2"))


@query("ml_27", f"select {K4}, l_quantity, round(a+b*l_quantity,3) predicted from lineitem, {LINE}")
def ml_27(spark, sf):
    p = M.predict(sql_model(spark, sf), spark.sql(f"SELECT {K4}, l_quantity FROM tg_lines"), "l_extendedprice")
    return p.select(*LI_KEYS, "l_quantity", rnd("predicted_l_extendedprice", 3).alias("predicted"))


@query("ml_28", "select count(*) n, 0.0::DOUBLE max_diff from lineitem")
def ml_28(spark, sf):
    m = sql_model(spark, sf)
    again = M.reload(m, scratch(spark, "model"))
    d = M.predict(m, table(spark, sf, "lineitem"), "l_extendedprice").withColumnRenamed("predicted_l_extendedprice", "_a")
    both = M.predict(again, d, "l_extendedprice")
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("_a") - F.col("predicted_l_extendedprice"))).alias("max_diff"))


@query("ml_29", """select p_brand run, count(*)::DOUBLE parts, round(avg(p_retailprice),4) mean_price, max(p_size)::DOUBLE top_size from part group by 1""")
def ml_29(spark, sf):
    """One run per brand: the long log is built, then searched, pivoted and ranked."""
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("run")).agg(F.count(F.lit(1)).cast("double").alias("parts"), F.avg("p_retailprice").alias("mean_price"), F.max("p_size").cast("double").alias("top_size"))
    runs = p.unpivot("run", ["parts", "mean_price", "top_size"], "key", "value")
    return M.run_table(runs, ["parts", "mean_price", "top_size"], "mean_price").withColumn("mean_price", rnd("mean_price", 4))


@query("ml_30", """with v as (select o_orderpriority model, o_custkey version, count(*) n from orders group by 1,2), e as (select o_orderpriority model, case when o_orderstatus='F' then 'champion' else 'candidate' end alias, o_custkey version, o_orderkey event_no from orders),
 c as (select model, alias, arg_max(version, event_no) version, count(*) moves from e group by 1,2) select c.model, alias, c.version, moves, n as runs from c join v on v.model=c.model and v.version=c.version""")
def ml_30(spark, sf):
    """Priorities as models, customers as versions, orders as alias events."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "champion").otherwise("candidate").alias("alias"), F.col("o_orderkey").alias("event_no"))
    versions = o.groupBy("model", "version").agg(F.count(F.lit(1)).alias("runs"))
    return M.registry_state(versions, o).select("model", "alias", "version", "moves", "runs")


@query("ml_31", f"""with t as (select min(l_quantity) lo, max(l_quantity) hi from lineitem where l_quantity <= 30) select {K4}, l_quantity, not l_quantity between lo and hi out_of_range, true forest_inside from lineitem, t""")
def ml_31(spark, sf):
    """Train on small quantities, score all: the forest mean stays inside the training labels, the line does not."""
    li = table(spark, sf, "lineitem")
    train = settle(li.where("l_quantity <= 30"), "small")
    forest = M.RandomForestRegressor(labelCol="l_extendedprice", numTrees=5, maxDepth=4, seed=42).fit(M.assembled(train, NUM))
    lin = M.linear(train, NUM, "l_extendedprice")
    ends = train.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    d = attach(forest.transform(M.assembled(M.out_of_range(li, train, ["l_quantity"]), NUM)), ends).withColumn("line", M.linear_expression(lin, NUM))
    return d.select(*LI_KEYS, "l_quantity", "out_of_range", F.col("prediction").between(F.col("_s.lo"), F.col("_s.hi")).alias("forest_inside"))


def quick():
    return M.LogisticRegression(maxIter=5)


@query("met_21")
def met_21(spark, sf):
    return M.filter_curve(docs(spark, sf), "doc_id", DOC_FEATS, "quality", quick).withColumn("mean_score", rnd("mean_score"))


@query("met_22")
def met_22(spark, sf):
    """The elimination curve: features kept at each size, their cross-validated accuracy, and the best size (ties to the smaller)."""
    curve = M.elimination_curve(docs(spark, sf), "doc_id", [*DOC_FEATS, "u"], "quality", quick)
    best = max(curve, key=lambda c: (c[1], -len(c[0])))[0]
    return spark.createDataFrame([(len(f), ",".join(f), float(a), f == best) for f, a in curve], "k int, features string, mean_score double, is_best boolean").withColumn("mean_score", rnd("mean_score"))


@query("met_23")
def met_23(spark, sf):
    """Two features by forward and by backward selection, in an outer cross-validation."""
    rows = [(how, i, ",".join(f), a) for how, forward in (("forward", True), ("backward", False))
            for i, f, a in M.outer_selection(docs(spark, sf), "doc_id", DOC_FEATS, "quality", 2, quick, forward)]
    return spark.createDataFrame(rows, "direction string, outer_fold int, features string, accuracy double").withColumn("accuracy", rnd("accuracy"))


@query("met_24")
def met_24(spark, sf):
    """The leak test at full size: 500 noise columns, 20 draws, the 10 best columns."""
    return selection_leak(docs(spark, sf), "doc_id", "toxic").withColumn("accuracy", rnd("accuracy"))


@query("src_9", f"select count(*) n, count(distinct strftime(l_shipdate,'%Y-%m')) as months, round(sum(a+b*l_quantity)/1e6,3) total_m from lineitem, {LINE}")
def src_9(spark, sf):
    """Score the whole table and write it by ship month; a re-run replaces only the months it holds."""
    m = M.linear(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    path = scratch(spark, "predictions")
    scored = table(spark, sf, "lineitem").select(*LI_KEYS, F.date_format("l_shipdate", "yyyy-MM").alias("month"), M.linear_expression(m, ["l_quantity"]).alias("prediction"))
    for _ in range(2):
        scored.hint("rebalance", "month").write.partitionBy("month").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("month").alias("months"), rnd(F.sum("prediction") / 1e6, 3).alias("total_m"))


@query("txt_8")
def txt_8(spark, sf):
    """Batch classification: label, confidence, correctness, in chunks of 128 rows."""
    from tidegauge.operators.ordering import row_numbers
    cal, _ = slices(spark, sf)
    m = M.LogisticRegression(labelCol="quality", maxIter=20).fit(M.assembled(cal, DOC_FEATS))
    p = M.scored(m, docs(spark, sf), DOC_FEATS)
    p = p.select("doc_id", "quality", F.col("prediction").cast("int").alias("pred"), F.greatest("prob", 1 - F.col("prob")).alias("confidence"))
    r = row_numbers(settle(p, "classified"), ["doc_id"], "pos")
    return r.select("doc_id", "quality", "pred", rnd("confidence").alias("confidence"), (F.col("quality") == F.col("pred")).alias("correct"), F.floor((F.col("pos") - 1) / 128).alias("chunk"))
