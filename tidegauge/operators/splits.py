"""Splits, resampling and leak detectors. Draws come from key hashes, ranks from split orderings, so a
class that holds most rows is never sorted in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.hashing import key_hash, unit_hash
from tidegauge.operators.joins import nearest_donors
from tidegauge.operators.ordering import attach, row_numbers
from tidegauge.operators.vectors import top_k


def random_split(df: DataFrame, keys: Sequence[str], test: float = 0.25, seed: int = 42) -> DataFrame:
    return df.withColumn("is_test", unit_hash(*keys, seed=seed) < test)


def _hash_ranks(df: DataFrame, key: str, by: Sequence[str], seed: int | Column) -> DataFrame:
    return row_numbers(df.withColumn("_h", key_hash(key, seed=seed)), ["_h", key], "_rank", by).drop("_h")


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """The same share of every class goes to test, exactly (rounded half up)."""
    r = _hash_ranks(df, key, [label], seed).join(_class_sizes(df, label), label)
    return r.withColumn("is_test", F.col("_rank") <= F.floor(F.col("_n") * F.lit(test) + 0.5)).drop("_rank", "_n")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    return _hash_ranks(df, key, [label], seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def expanding_folds(df: DataFrame, series: str, t: str, folds: int = 5, size: int = 12) -> DataFrame:
    """Each fold trains on all periods before its test block of ``size`` periods."""
    w = Window.partitionBy(series)
    d = df.withColumn("_rn", F.row_number().over(w.orderBy(t))).withColumn("_n", F.count(F.lit(1)).over(w))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    cut = F.col("_n") - (folds - F.col("fold")) * size
    return d.withColumn("role", F.when(F.col("_rn") <= cut, "train").when(F.col("_rn") <= cut + size, "test")).where(F.col("role").isNotNull()).drop("_rn", "_n")


def time_split(t: Column, first: Column, second: Column) -> Column:
    """Train up to the first cut-off, calibrate up to the second, test after it."""
    return F.when(t <= first, "train").when(t <= second, "calibrate").otherwise("test")


def nearest_in_time_gap(df: DataFrame, series: str, t: str, y: str, k: int = 5, test: float = 0.2, seed: int = 42) -> DataFrame:
    """RMSE of a k-nearest-in-time mean when test periods are drawn at random against the last ones."""
    w = Window.partitionBy(series)
    d = df.select(series, F.col(y).alias("y"), (F.row_number().over(w.orderBy(t)) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    cut = F.floor(F.col("n") * F.lit(test) + 0.5)
    d = d.withColumn("walk", F.col("i") >= F.col("n") - cut)
    d = d.withColumn("_h", key_hash(series, "i", seed=seed))
    d = d.withColumn("shuffled", F.row_number().over(w.orderBy("_h", "i")) <= cut).drop("_h").withColumn("x", F.col("i").cast("double"))
    out = None
    for scheme in ("walk", "shuffled"):
        hits = nearest_donors(d.where(F.col(scheme)), d.where(~F.col(scheme)), "i", "x", k, ["y"], [series])
        pred = hits.groupBy(series, "i").agg(F.avg("y").alias("p"))
        row = d.join(pred, [series, "i"]).groupBy(series).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2))).alias("rmse")).withColumn("scheme", F.lit(scheme))
        out = row if out is None else out.unionByName(row)
    return out


def _smallest_and_largest(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))


def undersample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, by hash order."""
    r = attach(_hash_ranks(df, key, [label], seed), _smallest_and_largest(df, label))
    return r.where(F.col("_rank") <= F.col("_s.lo")).drop("_rank", "_s")


def oversample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Every class filled up to the size of the largest by draws from its rows with replacement; ``copy`` numbers a row's repeats, 1 is the row.

    Row i of a class of n makes the draws i, i + n, ... that the class still needs, so draws are made where the rows are; they are counted before
    they meet the rows they hit.
    """
    r = attach(_hash_ranks(df, key, [label], seed).join(_class_sizes(df, label), label), _smallest_and_largest(df, label))
    lacking = F.col("_s.hi") - F.col("_n")
    draws = r.where(F.col("_rank") <= lacking).select(label, "_n", F.explode(F.sequence(F.col("_rank"), lacking, F.col("_n"))).alias("_draw"))
    hit = draws.select(label, (F.floor(unit_hash(label, "_draw", seed=seed) * F.col("_n")) + 1).alias("_rank")).groupBy(label, "_rank").agg(F.count(F.lit(1)).alias("_more"))
    out = r.join(hit, [label, "_rank"], "left")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.coalesce("_more", F.lit(0))))).select(*df.columns, "copy")


def bootstrap(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Resample of exactly the table's size with replacement: rows with their number of copies.

    Every rank draws one rank; draws are counted before they meet the rows, so the join is one to one.
    """
    ranked = row_numbers(df, [key], "_rank")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    draws = attach(ranked.select("_rank"), n).select((F.floor(unit_hash("_rank", seed=seed) * F.col("_s.n")) + 1).alias("_rank"))
    return ranked.join(draws.groupBy("_rank").agg(F.count(F.lit(1)).alias("copies")), "_rank").drop("_rank")


def resample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` draws from the table with replacement, as rows with their number of ``copies``. Draws are counted before they meet the rows."""
    ranked = row_numbers(df, [key], "_rank")
    draws = attach(df.sparkSession.range(1, size + 1).toDF("_draw"), df.agg(F.count(F.lit(1)).alias("n")))
    hit = draws.select((F.floor(unit_hash("_draw", seed=seed) * F.col("_s.n")) + 1).alias("_rank")).groupBy("_rank").agg(F.count(F.lit(1)).alias("copies"))
    return ranked.join(hit, "_rank").drop("_rank")


def smote(df: DataFrame, key: str, label: str, vec: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows for the smaller classes: a point between a row and one of its k nearest of its class."""
    sizes = _class_sizes(df, label)
    small = attach(df.join(sizes, label), _smallest_and_largest(df, label)).where(F.col("_n") < F.col("_s.hi"))
    need = _hash_ranks(small.select(key, label, vec, "_n", F.col("_s.hi").alias("_hi")), key, [label], seed)
    extra = F.col("_hi") - F.col("_n")
    times = F.floor(extra / F.col("_n")) + F.when(F.col("_rank") <= extra % F.col("_n"), 1).otherwise(0)
    seeds = need.withColumn("_t", times).where("_t > 0").select(key, label, F.col(vec).alias("_a"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_t"))).alias("copy"))
    near = top_k(small, small, key, vec, k, "euclid", exclude_self=True, by=label)
    pool = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", key))).alias("_near"))  # k entries
    s = seeds.join(pool.withColumnRenamed("query_id", key), key)
    pick = F.col("_near")[F.floor(unit_hash(key, "copy", seed=seed) * F.size("_near")).cast("int")][key]
    s = s.withColumn("neighbour", pick).drop("_near")
    s = s.join(small.select(F.col(key).alias("neighbour"), F.col(vec).alias("_b")), "neighbour")
    gap = unit_hash(key, "copy", seed=seed + 1)
    point = F.zip_with("_a", "_b", lambda a, b: a.cast("double") + gap * (b.cast("double") - a.cast("double")))
    return s.select(key, "copy", label, "neighbour", gap.alias("gap"), point.alias(vec))


def balanced_bags(df: DataFrame, key: str, label: str, bags: int, seed: int = 42) -> DataFrame:
    """``bags`` independent undersamples: each bag has its own hash order."""
    d = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    r = row_numbers(d.withColumn("_h", key_hash(key, "bag", seed=seed)), ["_h", key], "_rank", ["bag", label]).drop("_h")
    return attach(r, _smallest_and_largest(df, label)).where(F.col("_rank") <= F.col("_s.lo")).drop("_rank", "_s")


def resample_leak(df: DataFrame, key: str, label: str, test: float = 0.25) -> DataFrame:
    """Test rows that also occur in train when resampling comes before the split, and after it."""
    split = unit_hash(key, "copy", seed=7) < test
    early = oversample(df, key, label).withColumn("is_test", split)
    leaked = early.where("is_test").join(early.where("not is_test").select(key).distinct(), key, "left_semi")
    parts = random_split(df, [key], test, 7)
    late = oversample(parts.where("not is_test"), key, label)
    kept = parts.where("is_test").join(late.select(key).distinct(), key, "left_semi")
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias("leaked")).withColumn("order", F.lit(n))
    return count(leaked, "resample then split").unionByName(count(kept, "split then resample"))
