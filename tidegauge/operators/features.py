"""Imputation, scaling, encoding, binning and leak screens. Statistics are learned on the training part only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.hashing import unit_hash
from tidegauge.operators.aggregates import correlations, fit_statistics, most_frequent
from tidegauge.operators.joins import lookup_with_global_mean, nearest_donors
from tidegauge.operators.ordering import attach, exact_quantiles
from tidegauge.operators.stats import standardise
from tidegauge.session import settle

__all__ = ["standardise"]


def mask(df: DataFrame, column: str, key: str, fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """Hide a hashed share of a column, keeping the truth beside it."""
    hidden = unit_hash(key, seed=seed) < fraction
    return df.withColumn(f"{column}_true", F.col(column)).withColumn(column, F.when(~hidden, F.col(column)))


def impute(df: DataFrame, column: str, strategy: str, fit: DataFrame | None = None, constant=None, name: str | None = None) -> DataFrame:
    """Fill nulls with the mean, median or most frequent value of ``fit``, or a constant."""
    name, fit = name or column, fit if fit is not None else df
    if strategy == "constant":
        return df.withColumn(name, F.coalesce(F.col(column), F.lit(constant)))
    if strategy == "mean":
        stat = fit.agg(F.avg(column).alias("v"))
    elif strategy == "median":
        stat = exact_quantiles(fit, column, [0.5]).select(F.col("q")[0].alias("v"))
    elif strategy == "most_frequent":
        stat = most_frequent(fit, column).select(F.col("value").alias("v"))
    else:
        raise ValueError(strategy)
    return attach(df, stat, "_fill").withColumn(name, F.coalesce(F.col(column), F.col("_fill.v"))).drop("_fill")


def missing_indicators(df: DataFrame, columns: Sequence[str], fit: DataFrame) -> DataFrame:
    """0/1 columns beside imputed ones, null when the column had no gap at fit time."""
    gaps = fit.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns])
    return attach(df, gaps, "_gap").withColumns({
        f"{c}_missing": F.when(F.col(f"_gap.{c}"), F.col(c).isNull().cast("int")) for c in columns}).drop("_gap")


def knn_impute(df: DataFrame, key: str, feature: str, column: str, k: int = 5) -> DataFrame:
    """Mean of the k donors nearest in one always-observed feature."""
    hits = nearest_donors(df.where(F.col(column).isNull()), df.where(F.col(column).isNotNull()), key, feature, k, [column])
    fill = hits.groupBy(key).agg(F.avg(column).alias("_fill"))
    return df.join(fill, key, "left").withColumn(column, F.coalesce(column, "_fill")).drop("_fill")


def scorecard(strategies: dict[str, DataFrame], value: str, other: str) -> DataFrame:
    """Standard deviation and correlation per strategy, and their change against the first one (the truth)."""
    out = None
    for name, df in strategies.items():
        row = df.agg(F.stddev_samp(value).alias("std"), F.corr(value, other).alias("corr")).select(F.lit(name).alias("strategy"), "std", "corr")
        out = row if out is None else out.unionByName(row)
    first = next(iter(strategies))
    truth = strategies[first].agg(F.stddev_samp(value).alias("std"), F.corr(value, other).alias("corr"))
    return attach(out, truth).select(
        "strategy", "std", "corr", ((F.col("std") - F.col("_s.std")) / F.col("_s.std") * 100).alias("std_change_pct"),
        ((F.col("corr") - F.col("_s.corr")) / F.col("_s.corr") * 100).alias("corr_change_pct"))


def drop_cost(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows before and after dropping incomplete ones."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(whole).alias("after")).withColumn(
        "lost_pct", (F.col("before") - F.col("after")) / F.col("before") * 100)


def min_max(df: DataFrame, columns: Sequence[str], fit: DataFrame, suffix: str = "_mm") -> DataFrame:
    s = fit.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    return attach(df, s, "_fit").withColumns({
        f"{c}{suffix}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_fit.{c}_lo"), F.col(f"_fit.{c}_hi") - F.col(f"_fit.{c}_lo")), F.lit(0.0)) for c in columns}).drop("_fit")


def one_hot(df: DataFrame, column: str, levels: Sequence[str], drop: str | None = None) -> DataFrame:
    """0/1 columns per level; an unknown level gives all zeros. ``drop``: None, ``first`` or ``if_binary``."""
    keep = list(levels)
    if drop == "first" or (drop == "if_binary" and len(keep) == 2):
        keep = keep[1:]
    return df.withColumns({f"{column}_{i}": (F.coalesce(F.col(column) == v, F.lit(False))).cast("int") for i, v in enumerate(levels) if v in keep})


def ordinal(column: Column | str, levels: Sequence[str]) -> Column:
    """Position in the given order, -1 for an unknown level."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.coalesce(F.array_position(F.array(*[F.lit(v) for v in levels]), c), F.lit(0)) - 1).cast("int")


def fixed_bins(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins between fixed edges; outside is null."""
    out = None
    for lo, hi, lab in zip(edges, edges[1:], labels):
        hit = (x > lo) & (x <= hi)
        out = F.when(hit, lab) if out is None else out.when(hit, lab)
    return out


def quantile_bins(df: DataFrame, column: str, q: int, name: str, fit: DataFrame | None = None) -> DataFrame:
    """Equal-frequency bins, right-closed, lowest value included; edges are exact quantiles."""
    e = exact_quantiles(fit if fit is not None else df, column, [i / q for i in range(q + 1)])
    x = F.col(column)
    inside = x.between(F.col("_e.q")[0], F.col("_e.q")[q])
    above = F.size(F.filter(F.slice(F.col("_e.q"), 2, q - 1), lambda v: v < x))
    return attach(df, e, "_e").withColumn(name, F.when(inside, above)).drop("_e")


def grid_sector(lat: Column, lon: Column, box: tuple[float, float, float, float], n: int) -> Column:
    """Sector label R{row}C{column} on an n x n grid, clipped to the grid."""
    def index(x, lo, hi):
        edges = F.array(*[F.lit(lo + (hi - lo) * i / n) for i in range(n + 1)])
        return F.least(F.greatest(F.size(F.filter(edges, lambda e: e <= x)) - 1, F.lit(0)), F.lit(n - 1))

    return F.format_string("R%dC%d", index(lat, box[0], box[1]), index(lon, box[2], box[3]))


def powers(x: str, degree: int) -> dict[str, Column]:
    return {f"{x}_p{d}": F.pow(F.col(x), F.lit(d)) for d in range(1, degree + 1)}


def target_encoding_leak(df: DataFrame, key: str, target: str, is_train: Column) -> DataFrame:
    """Holdout RMSE of a line on the target mean per key, learned on train only and on all rows."""
    d = settle(df.select(key, target, is_train.alias("_train")), "encoding-input")  # three branches read it
    proper = lookup_with_global_mean(d, d.where("_train"), key, target, "_proper")
    both = lookup_with_global_mean(proper, d, key, target, "_leaky")
    line = proper.where("_train").agg(F.regr_slope(F.col(target), F.col("_proper")).alias("b"), F.regr_intercept(F.col(target), F.col("_proper")).alias("a"))
    err = lambda enc: F.sqrt(F.avg(F.pow(F.col(target) - (F.col("_l.a") + F.col("_l.b") * F.col(enc)), 2)))
    return attach(both.where(~F.col("_train")), line, "_l").agg(err("_proper").alias("rmse_proper"), err("_leaky").alias("rmse_leaky"))


def fit_drift(df: DataFrame, columns: Sequence[str], is_train: Column) -> DataFrame:
    """Mean and population sd learned on all rows against the training rows only."""
    t = lambda c: F.when(is_train, F.col(c))
    one = df.agg(*[F.array(F.avg(c), F.avg(t(c)), F.stddev_pop(c), F.stddev_pop(t(c))).alias(c) for c in columns])
    long = one.unpivot([], list(columns), "column", "s")
    return long.select("column", F.col("s")[0].alias("mean_all"), F.col("s")[1].alias("mean_train"), F.col("s")[2].alias("sd_all"), F.col("s")[3].alias("sd_train"))


def leak_screen(df: DataFrame, label: str, features: Sequence[str], threshold: float = 0.999) -> DataFrame:
    """Features that equal or nearly determine the label."""
    one = df.agg(*[F.struct(F.corr(f, label).alias("r"), F.avg((F.col(f) == F.col(label)).cast("double")).alias("equal_rate")).alias(f) for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f)["r"].alias("r"), F.col(f)["equal_rate"].alias("equal_rate")) for f in features])
    leak = (F.abs(F.col("r")) >= threshold) | (F.col("equal_rate") >= threshold)
    return one.select(F.inline(rows)).withColumn("leak", F.coalesce(leak, F.lit(False)))


def near_duplicates(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Column pairs that say the same thing in other units."""
    return correlations(df, columns).where(F.abs(F.col("r")) >= threshold)


def train_statistics(df: DataFrame, column: str) -> DataFrame:
    return fit_statistics(df, column)
