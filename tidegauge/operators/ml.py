"""Model training and scoring on MLlib: pipelines, calibration, resampled ensembles, selection, registry tables."""
from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, LogisticRegressionModel, OneVsRest, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import logit, sigmoid
from tidegauge.operators.features import impute
from tidegauge.operators.ordering import attach, bucket_target, carry_last, order_buckets
from tidegauge.operators.splits import balanced_bags, stratified_folds
from tidegauge.operators.stats import anova_f
from tidegauge.session import settle


def assembled(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="keep").transform(df)


def positive(model_output: DataFrame, name: str = "prob") -> DataFrame:
    """Probability of class 1 as a plain column."""
    return model_output.withColumn(name, vector_to_array("probability")[1])


def scored(model, df: DataFrame, features: Sequence[str], prob: str | None = "prob") -> DataFrame:
    """``df`` with ``prediction`` and the probability of class 1.

    A binary logistic model is applied as an expression: no user function, and nothing of the fitted model's training
    summary travels with the plan.
    """
    if isinstance(model, LogisticRegressionModel) and model.numClasses == 2:
        p = sigmoid(linear_expression(model, features))
        return df.withColumns({**({prob: p} if prob else {}), "prediction": (p > 0.5).cast("double")})
    out = model.transform(assembled(df, features))
    if prob:
        out = positive(out, prob)
    return out.drop("features", "rawPrediction", "probability")


def preparation(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Scale numeric and one-hot encode categorical columns (unseen levels become their own slot)."""
    stages = [VectorAssembler(inputCols=list(numeric), outputCol="_num", handleInvalid="keep"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
    if categorical:
        stages += [StringIndexer(inputCols=list(categorical), outputCols=[f"_{c}_i" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=[f"_{c}_i" for c in categorical], outputCols=[f"_{c}_v" for c in categorical], handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=["_scaled", *[f"_{c}_v" for c in categorical]], outputCol="features"))
    return stages


def fit_pipeline(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], estimator) -> PipelineModel:
    """Scale, encode and fit under one fit/transform contract; impute before it with ``features.impute`` on train."""
    return Pipeline(stages=[*preparation(numeric, categorical), estimator]).fit(train)


def impute_all(df: DataFrame, columns: Sequence[str], fit: DataFrame) -> DataFrame:
    for c in columns:
        df = impute(df, c, "mean", fit)
    return df


def linear(train: DataFrame, features: Sequence[str], label: str, **kw):
    return LinearRegression(solver="normal", featuresCol="features", labelCol=label, **kw).fit(assembled(train, features))


def coefficient_table(model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    rows = [("(intercept)", float(model.intercept)), *[(f, float(c)) for f, c in zip(features, model.coefficients)]]
    return spark.createDataFrame(rows, "term string, coef double")


def importance_table(model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    v = model.featureImportances
    return spark.createDataFrame([(f, float(v[i])) for i, f in enumerate(features)], "feature string, importance double")


def linear_expression(model, features: Sequence[str]) -> Column:
    """A linear model as a column expression: scoring stays in generated code and works in any query."""
    out = F.lit(float(model.intercept))
    for f, c in zip(features, model.coefficients):
        out = out + F.lit(float(c)) * F.col(f)
    return out


def fit_all(fits: Sequence[Callable], at_once: int = 4) -> list:
    """Results of several fits on one written table, a few at a time, in order."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda f: f(), fits))


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("k"))
    w = attach(sizes, total).select(label, (F.col("_s.n") / (F.col("_s.k") * F.col("_c"))).alias(name))
    return df.join(w, label)


def majority_baseline(train: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent class (ties to the smallest) and the mean label."""
    top = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("majority"))
    return attach(train.agg(F.avg(label).alias("mean")), top).select("_s.majority", "mean")


STACK = "b int, lo double, hi double, s double, w double"


def pool_adjacent(lo: np.ndarray, hi: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring blocks (score range, sum, weight; in order) pooled until their means rise strictly."""
    top = np.zeros(len(lo) + 1, np.int64)  # the stack: where each block begins
    total, weight, n = s.astype(float).copy(), w.astype(float).copy(), 0
    for i in range(len(lo)):
        top[n], total[n], weight[n] = i, s[i], w[i]
        while n and total[n - 1] * weight[n] >= total[n] * weight[n - 1]:
            n -= 1
            total[n] += total[n + 1]
            weight[n] += weight[n + 1]
        n += 1
    top[n] = len(lo)
    return lo[top[:n]], hi[top[1:n + 1] - 1], total[:n], weight[:n]


def isotonic_steps(calibrate: DataFrame, score: str, label: str, fan: int = 8) -> DataFrame:
    """(x0, v0, x1, v1), settled: the thresholds of the least-squares monotone fit, in order, each with its right neighbour (null after the last).

    Parallel pool-adjacent-violators: labels are summed per distinct score, scores go to order buckets, and each bucket pools its own blocks.
    ``fan`` neighbouring stacks merge at a time until one is left; pooling stacks gives the blocks of pooling all rows. A stack is what a task
    holds: its means rise strictly, so n rows with 0/1 labels leave about n^(2/3) blocks at most. Null scores and labels take no part.
    """
    rows = calibrate.select(F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y")).where("x is not null and not isnan(x) and y is not null")
    counted = settle(rows.groupBy("x").agg(F.sum("y").alias("s"), F.count(F.lit(1)).cast("double").alias("w")), "scores")
    stacks = order_buckets(counted, ["x"], "b").select("b", F.col("x").alias("lo"), F.col("x").alias("hi"), "s", "w")

    def pooled(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo")
        out = pool_adjacent(*(rows[c].to_numpy() for c in ("lo", "hi", "s", "w")))
        return pd.DataFrame({"b": rows["b"].iloc[0], **dict(zip(("lo", "hi", "s", "w"), out))})

    left = bucket_target(counted)
    stacks = stacks.groupBy("b").applyInPandas(pooled, STACK)
    while left > 1:
        stacks, left = stacks.withColumn("b", F.floor(F.col("b") / fan).cast("int")).groupBy("b").applyInPandas(pooled, STACK), -(-left // fan)

    def thresholds(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo")
        v = (rows["s"] / rows["w"]).to_numpy()
        ends = np.stack([rows["lo"].to_numpy(), rows["hi"].to_numpy()], 1)
        once = np.stack([np.ones(len(v), bool), ends[:, 0] < ends[:, 1]], 1).ravel()
        x, v = ends.ravel()[once], np.repeat(v, 2)[once]
        return pd.DataFrame({"x0": x, "v0": v, "x1": np.append(x[1:], np.nan), "v1": np.append(v[1:], np.nan)})

    return settle(stacks.groupBy("b").applyInPandas(thresholds, "x0 double, v0 double, x1 double, v1 double"), "thresholds")


def isotonic(calibrate: DataFrame, test: DataFrame, score: str, label: str, name: str = "calibrated") -> DataFrame:
    """Monotone map from a score to a rate: the exact least-squares fit over the calibration slice (``isotonic_steps``).

    Between two thresholds the rate is interpolated linearly, outside them it is that of the nearest one. A null score, or an empty calibration
    slice, gives null. Tied scores have one rate. Thresholds are carried to the test scores in one ordered pass.
    """
    steps = isotonic_steps(calibrate, score, label)
    lowest = steps.agg(F.min_by("v0", "x0").alias("v"))
    at = F.struct("x0", "v0", F.nanvl("x1", F.lit(None)).alias("x1"), F.nanvl("v1", F.lit(None)).alias("v1"))
    rows = steps.select(F.col("x0").alias("_x"), F.lit(0).alias("_kind"), at.alias("_at"), F.lit(None).cast(test.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    asked = test.select(F.struct("*").alias("_row")).select(F.col(f"_row.`{score}`").cast("double").alias("_x"), F.lit(1).alias("_kind"), F.lit(None).alias("_at"), "_row")
    both = rows.union(asked)
    known = attach(carry_last(both, ["_x", "_kind"], {"_at": "_near"}).where("_kind = 1"), lowest, "_low")
    gap = (F.col("_x") - F.col("_near.x0")) / (F.col("_near.x1") - F.col("_near.x0"))
    value = F.when(F.col("_near").isNull(), F.col("_low.v")).otherwise(
        F.coalesce(F.col("_near.v0") + (F.col("_near.v1") - F.col("_near.v0")) * gap, F.col("_near.v0")))
    return known.select("_row.*", F.when(F.col("_x").isNotNull() & ~F.isnan("_x"), value).alias(name))


def platt(calibrate: DataFrame, test: DataFrame, score: str, label: str, name: str = "calibrated") -> DataFrame:
    """One-feature logistic map of the score, applied as an expression."""
    m = LogisticRegression(featuresCol="_f", labelCol=label, regParam=0.0).fit(VectorAssembler(inputCols=[score], outputCol="_f").transform(calibrate))
    return test.withColumn(name, sigmoid(F.lit(float(m.intercept)) + F.lit(float(m.coefficients[0])) * F.col(score)))


def cross_calibrated(resampled: DataFrame, test: DataFrame, key: str, features: Sequence[str], label: str, folds: int = 5) -> DataFrame:
    """Mean of per-fold isotonic maps fitted on resampled data: the calibrator never sees the true rate."""
    parts = settle(stratified_folds(resampled, key, label, folds), "folds")
    out = test
    for k in range(folds):
        m = LogisticRegression(labelCol=label).fit(assembled(parts.where(F.col("fold") != k), features))
        held = scored(m, parts.where(F.col("fold") == k), features, "_s").select(label, "_s")
        out = isotonic(held, scored(m, out, features, "_s").drop("prediction"), "_s", label, f"_c{k}").drop("_s")
        out = settle(out, "calibrated")  # else each fold's ordered pass would run all earlier ones again
    mean = sum((F.col(f"_c{k}") for k in range(1, folds)), F.col("_c0")) / folds
    return out.withColumn("calibrated", mean).drop(*[f"_c{k}" for k in range(folds)])


def prior_corrected(p: Column, true_rate: Column, sample_rate: Column) -> Column:
    """Score with its log-odds shifted from the sample rate to the true rate."""
    return sigmoid(logit(p) + logit(true_rate) - logit(sample_rate))


def bagged_probability(train: DataFrame, test: DataFrame, key: str, features: Sequence[str], label: str, bags: int, make: Callable) -> DataFrame:
    """One model per balanced bag; probabilities are averaged per row of ``test``."""
    members = settle(balanced_bags(train.select(key, label, *features), key, label, bags), "bags")
    out = assembled(test, features)
    for b, m in enumerate(fit_all([lambda b=b: make().setLabelCol(label).setFeaturesCol("features").fit(assembled(members.where(F.col("bag") == b), features)) for b in range(bags)])):
        out = positive(m.transform(out), f"_p{b}").drop("rawPrediction", "probability", "prediction")
    return out.withColumn("prob", sum((F.col(f"_p{b}") for b in range(1, bags)), F.col("_p0")) / bags).drop("features", *[f"_p{b}" for b in range(bags)])


def cross_validated(df: DataFrame, key: str, features: Sequence[str], label: str, make: Callable, folds: int = 5, fold_col: str | None = None) -> DataFrame:
    """Accuracy per stratified fold; summarise with mean and sd."""
    parts = df.withColumnRenamed(fold_col, "fold") if fold_col else settle(stratified_folds(df.select(key, label, *features), key, label, folds), "folds")
    d = assembled(parts, features)
    out = None
    for k, m in enumerate(fit_all([lambda k=k: make().setLabelCol(label).setFeaturesCol("features").fit(d.where(F.col("fold") != k)) for k in range(folds)])):
        row = scored(m, parts.where(F.col("fold") == k), features, None).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")).withColumn("fold", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return settle(out, "cv-scores")


def cv_mean(df: DataFrame, key: str, features: Sequence[str], label: str, make: Callable, folds: int = 3) -> float:
    return cross_validated(df, key, features, label, make, folds).agg(F.avg("accuracy")).first()[0]


def family_search(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, families: dict[str, Callable], budget: int | None = None) -> DataFrame:
    """Log-loss leaderboard of the first ``budget`` model families (None: all). The budget counts fits, so a slow cluster gives the same rows."""
    rows = []
    tr, te = settle(train, "train"), settle(test, "test")
    for name, make in list(families.items())[:budget]:
        t0 = time.monotonic()
        m = make().setLabelCol(label).setFeaturesCol("features").fit(assembled(tr, features))
        p = F.greatest(F.least(F.col("prob"), F.lit(1 - 1e-6)), F.lit(1e-6))
        loss = scored(m, te, features).agg(F.avg(-F.log(F.when(F.col(label) == 1, p).otherwise(1 - p)))).first()[0]
        rows.append((name, float(loss), time.monotonic() - t0))
    board = train.sparkSession.createDataFrame(rows, "family string, log_loss double, seconds double")
    return board.withColumn("place", F.row_number().over(Window.orderBy("log_loss", "family")))  # one row per family


def random_search(df: DataFrame, features: Sequence[str], label: str, key: Column, grid: dict[str, Sequence], draws: int, make: Callable, folds: int = 3, seed: int = 42) -> DataFrame:
    """RMSE of hash-picked parameter draws by cross-validation.

    ``make`` must be seeded: draws of the same parameters are then the same forests on the same folds, which are fitted once, and each draw keeps its row.
    """
    import hashlib

    def pick(i: int, name: str, values: Sequence):
        return values[int(hashlib.md5(f"{seed}|{i}|{name}".encode()).hexdigest()[:8], 16) % len(values)]

    parts = settle(df.select(label, *features, F.floor(key * folds).cast("int").alias("fold")), "folds")
    d, rows, known = assembled(parts, features), [], {}

    def error(params: dict) -> float:
        sq = None
        for k in range(folds):
            m = make(**params).setLabelCol(label).setFeaturesCol("features").fit(d.where(F.col("fold") != k))
            part = m.transform(d.where(F.col("fold") == k)).select(F.pow(F.col("prediction") - F.col(label), 2).alias("sq"))
            sq = part if sq is None else sq.unionByName(part)
        return float(sq.agg(F.sqrt(F.avg("sq"))).first()[0])

    for i in range(draws):
        params = {n: pick(i, n, v) for n, v in grid.items()}
        text = str(params)
        if text not in known:
            known[text] = error(params)
        rows.append((i, text, known[text]))
    return df.sparkSession.createDataFrame(rows, "draw int, params string, rmse double")


def train_model(spark: SparkSession, sql: str, label: str, model_type: str, options: dict | None = None) -> PipelineModel:
    """TRAIN from a query: every other column is a feature; strings are encoded. Types: linear_reg, logistic_reg,
    boosted_tree_regressor, random_forest_regressor, kmeans."""
    df, options = spark.sql(sql), options or {}
    feats = [f for f in df.schema.fields if f.name != label]
    cat = [f.name for f in feats if f.dataType.simpleString() == "string"]
    num = [f.name for f in feats if f.name not in cat]
    kinds = {"linear_reg": LinearRegression, "logistic_reg": LogisticRegression, "boosted_tree_regressor": GBTRegressor, "random_forest_regressor": RandomForestRegressor}
    if model_type == "kmeans":
        est = KMeans(featuresCol="features", predictionCol=f"predicted_{label}", **options)
    else:
        est = kinds[model_type](featuresCol="features", labelCol=label, predictionCol=f"predicted_{label}", **options)
    return fit_pipeline(df, num, cat, est)


def predict(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """PREDICT: the input columns and ``predicted_<label>``."""
    return model.transform(df).select(*df.columns, f"predicted_{label}")


def evaluate(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """EVALUATE: one metric row for a held-out query."""
    from tidegauge.operators.metrics import regression_metrics

    return regression_metrics(predict(model, df, label), label, f"predicted_{label}")


def reload(model: PipelineModel, path: str) -> PipelineModel:
    """Export and import a fitted model."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def run_table(runs: DataFrame, keys: Sequence[str], rank_by: str) -> DataFrame:
    """Long (run, key, value) log pivoted to one row per run and ranked."""
    wide = runs.groupBy("run").pivot("key", list(keys)).agg(F.max("value"))
    return wide.orderBy(F.desc(rank_by), "run")


def registry_state(versions: DataFrame, alias_events: DataFrame) -> DataFrame:
    """Current version behind every (model, alias): the newest event wins."""
    now = alias_events.groupBy("model", "alias").agg(F.max_by("version", "event_no").alias("version"), F.count(F.lit(1)).alias("moves"))
    return now.join(versions, ["model", "version"])


def out_of_range(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Flag rows outside the training range of any feature."""
    s = train.agg(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in features])
    outside = F.lit(False)
    for f in features:
        outside = outside | ~F.col(f).between(F.col(f"_rng.{f}.lo"), F.col(f"_rng.{f}.hi"))
    return attach(df, s, "_rng").withColumn("out_of_range", outside).drop("_rng")


# --- forecasting: lags by window, one k x k solve per series from its moment row

def lag_backtest(df: DataFrame, series: str, t: str, y: str, lags: Sequence[int], folds: int = 5, size: int = 12, trend: int = 0) -> DataFrame:
    """Expanding-window backtest of a least-squares regression on the given lags.

    ``trend`` > 0 first removes a polynomial in time fitted on the training part. With lags 1 and 12 this
    is the re-aimed seasonal autoregression (least squares instead of maximum likelihood); forecasts are
    one step ahead. Returns RMSE per (series, fold).
    """
    from tidegauge.operators.splits import expanding_folds
    from tidegauge.operators.stats import cross_products, solve_rows
    import numpy as np

    w = Window.partitionBy(series)
    base = df.withColumn("_t", (F.row_number().over(w.orderBy(t)) / F.count(F.lit(1)).over(w)).cast("double"))
    base = base.withColumn("_scale", F.avg(y).over(w)).withColumn("_y", F.col(y) / F.col("_scale"))
    kind = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)[series]

    def solve(d: DataFrame, cols: list[str], target: str, name: str) -> DataFrame:
        k = len(cols) + 1
        fn = lambda m: [([float(b) for b in np.linalg.lstsq(m[:k - 1, :k - 1], m[:k - 1, k - 1], rcond=None)[0]],)]
        return solve_rows(cross_products(d, [*cols, target], [series, "fold"]), k, [series, "fold"], f"{series} {kind}, fold int, {name} array<double>", fn)

    f = expanding_folds(base, series, t, folds, size)
    f = f.withColumn("_one", F.lit(1.0))
    target = "_y"
    if trend:
        tc = ["_one", *[f"_t{i}" for i in range(1, trend + 1)]]
        f = f.withColumns({f"_t{i}": F.pow("_t", F.lit(i)) for i in range(1, trend + 1)})
        coef = solve(f.where("role = 'train'"), tc, "_y", "_tb")
        f = f.join(coef, [series, "fold"])
        fit = sum((F.col("_tb")[i] * F.col(c) for i, c in enumerate(tc[1:], 1)), F.col("_tb")[0])
        f = f.withColumn("_trend", fit).withColumn("_r", F.col("_y") - F.col("_trend"))
        target = "_r"
    else:
        f = f.withColumn("_trend", F.lit(0.0))
    wf = Window.partitionBy(series, "fold").orderBy(t)
    lc = [f"_lag{k}" for k in lags]
    f = f.withColumns({f"_lag{k}": F.lag(target, k).over(wf) for k in lags}).na.drop(subset=lc)
    cols = ["_one", *lc]
    f = settle(f.select(series, "fold", "role", "_scale", "_y", "_trend", target if target != "_y" else F.col("_y").alias("_r"), *cols), "lags")
    beta = solve(f.where("role = 'train'"), cols, "_r", "_b")
    pred = sum((F.col("_b")[i] * F.col(c) for i, c in enumerate(cols[1:], 1)), F.col("_b")[0]) + F.col("_trend")
    return f.where("role = 'test'").join(beta, [series, "fold"]).groupBy(series, "fold").agg(
        F.sqrt(F.avg(F.pow((F.col("_y") - pred) * F.col("_scale"), 2))).alias("rmse"))


# --- feature selection: driver loops over fits on a settled table

def rank_once(df: DataFrame, features: Sequence[str], label: str) -> str:
    """Feature with the smallest absolute standardised coefficient of a logistic fit."""
    from tidegauge.operators.stats import standardise

    z = standardise(df, features)
    m = LogisticRegression(labelCol=label, regParam=0.001).fit(assembled(z, [f"{f}_z" for f in features]))
    return min(zip(features, m.coefficients), key=lambda p: (abs(p[1]), p[0]))[0]


def recursive_elimination(df: DataFrame, features: Sequence[str], label: str, k: int) -> list[str]:
    keep = list(features)
    d = settle(df.select(label, *features), "rfe")
    while len(keep) > k:
        keep.remove(rank_once(d, keep, label))
    return keep


def elimination_curve(df: DataFrame, key: str, features: Sequence[str], label: str, make: Callable, folds: int = 5) -> list[tuple[list[str], float]]:
    """(features kept, cross-validated accuracy) from all features down to one, dropping the weakest each time."""
    keep, out = list(features), []
    d = settle(df.select(key, label, *features), "rfe")
    while keep:
        out.append((list(keep), cv_mean(d, key, keep, label, make, folds)))
        if len(keep) == 1:
            break
        keep.remove(rank_once(d, keep, label))
    return out


def outer_selection(df: DataFrame, key: str, features: Sequence[str], label: str, k: int, make: Callable, forward: bool = True, inner: int = 5, outer: int = 3) -> list[tuple[int, list[str], float]]:
    """(outer fold, features chosen on its training part, accuracy on its held part): the selection never sees the rows that score it."""
    d = settle(stratified_folds(df.select(key, label, *features), key, label, outer, seed=43).withColumnRenamed("fold", "outer"), "outer")
    out = []
    for i in range(outer):
        train, held = d.where(F.col("outer") != i), d.where(F.col("outer") == i)
        chosen = sequential_selection(train, key, features, label, k, make, forward, inner)
        m = make().setLabelCol(label).setFeaturesCol("features").fit(assembled(train, chosen))
        hit = scored(m, held, chosen, None).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        out.append((i, chosen, float(hit)))
    return out


def sequential_selection(df: DataFrame, key: str, features: Sequence[str], label: str, k: int, make: Callable, forward: bool = True, folds: int = 5) -> list[str]:
    """Greedy selection by cross-validated accuracy; the candidate fits of a step run side by side."""
    d = settle(stratified_folds(df.select(key, label, *features), key, label, folds), "selection")

    def value(fs: list[str]) -> float:
        x = assembled(d, fs)
        total = None
        for i in range(folds):
            m = make().setLabelCol(label).setFeaturesCol("features").fit(x.where(F.col("fold") != i))
            hit = scored(m, d.where(F.col("fold") == i), fs, None).select((F.col("prediction") == F.col(label)).cast("double").alias("h"))
            total = hit if total is None else total.unionByName(hit)
        return total.agg(F.avg("h")).first()[0]

    chosen = [] if forward else list(features)
    while len(chosen) != k:
        options = [chosen + [f] for f in features if f not in chosen] if forward else [[g for g in chosen if g != f] for f in chosen]
        with ThreadPoolExecutor(4) as pool:
            scores = list(pool.map(value, options))
        chosen = max(zip(scores, options), key=lambda p: (p[0], [-features.index(f) for f in p[1]]))[1]
    return chosen


def filter_curve(df: DataFrame, key: str, features: Sequence[str], label: str, make: Callable, folds: int = 5) -> DataFrame:
    """Accuracy for the k best features, k = 1..all; the F scores are computed inside each training fold."""
    d = settle(stratified_folds(df.select(key, label, *features), key, label, folds), "knee")
    rows = []
    for i in range(folds):
        train = d.where(F.col("fold") != i)
        order = [r["feature"] for r in anova_f(train, label, features).orderBy(F.desc("f"), "feature").collect()]
        for k in range(1, len(order) + 1):
            m = make().setLabelCol(label).setFeaturesCol("features").fit(assembled(train, order[:k]))
            hit = scored(m, d.where(F.col("fold") == i), order[:k], None).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
            rows.append((k, i, float(hit)))
    return df.sparkSession.createDataFrame(rows, "k int, fold int, accuracy double").groupBy("k").agg(F.avg("accuracy").alias("mean_score"))


__all__ = ["ALS", "DecisionTreeClassifier", "GBTClassifier", "GBTRegressor", "OneVsRest", "PCA", "RandomForestClassifier", "RandomForestRegressor"]
