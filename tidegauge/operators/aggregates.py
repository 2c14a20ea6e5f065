"""Profiles, tables of counts, and voting aggregates."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordering import attach, exact_quantiles, same
from tidegauge.session import settle


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "column", value: str = "value") -> DataFrame:
    """One row per (row, numeric column)."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.inline(pairs))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sd (n-1), min, exact quartiles and max per column, with its dtype and the table's shape."""
    long = long_form(df, columns)
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    kinds = dict(df.dtypes)
    basic = basic.withColumn("dtype", F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(kinds[c]))])[F.col("column")])
    basic = attach(basic, df.agg(F.count(F.lit(1)).alias("n"))).withColumns({"n_rows": F.col("_s.n"), "n_columns": F.lit(len(df.columns))}).drop("_s")
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"])
    return basic.join(q.select("column", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")), "column", "left")


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count and percent per column, in one pass."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return sums.unpivot("n", list(columns), "column", "missing").select(
        "column", "missing", (F.col("missing") / F.col("n") * 100).alias("pct"))


def missing_pattern(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Which columns are missing together: one row per 0/1 mask (and group)."""
    mask = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return df.groupBy(*group, mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str, label: str | None = None) -> DataFrame:
    """Counts per value including null, with shares."""
    counts = df.groupBy(F.col(column).alias(label or column)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"))
    return attach(counts, total).withColumn("share", F.col("n") / F.col("_s.n")).drop("_s")


def crosstab(df: DataFrame, rows: str, cols: str, levels: Sequence[str]) -> DataFrame:
    """Contingency table with given column levels."""
    return df.groupBy(rows).pivot(cols, list(levels)).count().na.fill(0)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max; the last one is closed; empty bins have count 0."""
    v = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = attach(v, ends)
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    idx = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("_s.lo")) / width), F.lit(bins - 1))).cast("int")
    counts = b.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = attach(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")), ends)
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("_s.lo") + F.col("bin") * width).alias("left"), F.coalesce("n", F.lit(0)).alias("n"))


def box_summary(df: DataFrame, column: str, group: str) -> DataFrame:
    """Quartiles, whisker ends at 1.5 IQR and outlier count per group."""
    q = exact_quantiles(df, column, [0.25, 0.5, 0.75], [group]).select(
        group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    v, lo, hi = F.col(column), F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = v.between(lo, hi)
    return same(df.select(group, column), q, [group]).groupBy(group, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("outliers"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every column pair in one aggregation, long form."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """Most frequent non-null value, ties to the smallest: one row (value, n)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(1)


def fit_statistics(df: DataFrame, column: str) -> DataFrame:
    """Mean, median and most frequent value as one row."""
    mean = df.agg(F.avg(column).alias("mean"))
    med = exact_quantiles(df, column, [0.5]).select(F.col("q")[0].alias("median"))
    return attach(attach(mean, med, "_m"), most_frequent(df, column), "_f").select(
        "mean", F.col("_m.median").alias("median"), F.col("_f.value").alias("mode"))


def tally(statements: DataFrame, debate: str, speaker: str, round_no: str, verdict: str) -> DataFrame:
    """Latest verdict per speaker; a winner needs more than half of ALL speakers, abstainers included."""
    last = statements.groupBy(debate, speaker).agg(F.max_by(verdict, round_no).alias("_v"))
    counts = last.groupBy(debate, "_v").agg(F.count(F.lit(1)).alias("_n"))
    cast = F.col("_v").isNotNull()
    out = counts.groupBy(debate).agg(
        F.sum("_n").alias("speakers"),
        F.coalesce(F.sum(F.when(cast, F.col("_n"))), F.lit(0)).alias("votes"),
        F.max(F.when(cast, F.struct("_n", "_v"))).alias("_top"))
    won = F.coalesce(F.col("_top._n") * 2 > F.col("speakers"), F.lit(False))
    return out.select(debate, "speakers", "votes", F.when(won, F.col("_top._v")).alias("winner"), (~won).alias("deadlock"))


def debate_outcome(statements: DataFrame, debate: str, speaker: str, round_no: str, verdict: str) -> DataFrame:
    """Rounds run and stop reason: a debate stops at the first round where all speakers cast one verdict."""
    per_round = statements.groupBy(debate, round_no).agg(
        F.count(F.lit(1)).alias("_n"), F.count(verdict).alias("_cast"), F.min(verdict).alias("_lo"), F.max(verdict).alias("_hi"))
    all_agree = (F.col("_n") == F.col("_cast")) & (F.col("_lo") == F.col("_hi"))
    d = per_round.groupBy(debate).agg(
        F.max(round_no).alias("_last"), F.min(F.when(all_agree, F.col(round_no))).alias("_first"),
        F.min_by("_lo", F.when(all_agree, F.col(round_no))).alias("_win"))
    return d.select(
        debate, F.coalesce("_first", "_last").alias("rounds_run"),
        F.when(F.col("_first").isNotNull(), "unanimous").otherwise("max_rounds").alias("stop_reason"),
        F.col("_first").isNotNull().alias("unanimous"), F.when(F.col("_first").isNotNull(), F.col("_win")).alias("winner"))


def keep_first(df: DataFrame, features: Sequence[str], order: str) -> DataFrame:
    """First row of each set of exact copies, by partial aggregation on a 128-bit digest of the features."""
    text = F.to_json(F.struct(*features))
    first = df.groupBy(F.md5(text).alias("_d")).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


def episode_summary(df: DataFrame, policy: str, won: Column, reward: str, steps: str) -> DataFrame:
    return df.groupBy(policy).agg(
        F.count(F.lit(1)).alias("episodes"), F.avg(won.cast("double")).alias("win_rate"),
        F.avg(reward).alias("mean_reward"), F.avg(steps).alias("mean_steps"))


def contribution(df: DataFrame, dims: Sequence[str], metric: Column, is_test: Column) -> DataFrame:
    """Metric in test and control for every subset of the dimensions, with each side's share of its total."""
    t = df.select(*dims, F.when(is_test, metric).otherwise(0).alias("_t"), F.when(is_test, 0).otherwise(metric).alias("_c"))
    cells = t.cube(*dims).agg(F.grouping_id().alias("grouping"), F.sum("_t").alias("test"), F.sum("_c").alias("control"))
    whole = t.agg(F.sum("_t").alias("test"), F.sum("_c").alias("control"))
    return attach(cells, whole).withColumns({
        "test_share": F.col("test") / F.col("_s.test"), "control_share": F.col("control") / F.col("_s.control"),
        "difference": F.col("test") - F.col("control")}).drop("_s")


def frequent_contribution(df: DataFrame, dims: Sequence[str], metric: Column, is_test: Column, support: float = 0.01) -> DataFrame:
    """``contribution`` for the cells that hold at least the share ``support`` of the rows, with their row count ``n``; level by level instead of the cube.

    Rows are counted per combination of all dimensions once. At each level a combination offers only those subsets of dimensions whose cells
    one dimension smaller are all frequent for it, so a rare value costs nothing beyond the first level. Each subset has at most 1 / support
    frequent cells, which bounds the list of a level that goes back to the combinations. ``grouping`` is Spark's and SQL's: the first dimension has the
    highest bit, which is 1 where the dimension is summed over. A null value is a value like any other; an empty table has no cells.
    """
    dims = list(dims)
    bit = {d: 1 << (len(dims) - 1 - i) for i, d in enumerate(dims)}
    t = df.select(*dims, F.lit(1).cast("long").alias("_n"), F.when(is_test, metric).otherwise(0).alias("_t"), F.when(is_test, 0).otherwise(metric).alias("_c"))
    base = settle(t.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in ("_n", "_t", "_c")]), "combinations")
    whole = settle(base.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_n", "_t", "_c")]), "totals")

    def cell(mask: int) -> Column:  # the mask's dimensions by name and value; nulls are kept
        return F.to_json(F.struct(F.lit(mask).alias("_"), *[F.col(d) for d in dims if mask & bit[d]]), {"ignoreNullFields": "false"})

    rows, out = base.withColumn("_alive", F.array(F.lit(0))), []
    everything = whole.select(*[F.lit(None).cast(base.schema[d].dataType).alias(d) for d in dims], F.lit(0).alias("_mask"), "_n", "_t", "_c").where("_n > 0")
    for k in range(1, len(dims) + 1):
        offers = []
        for chosen in combinations(dims, k):
            mask = sum(bit[d] for d in chosen)
            smaller = F.array(*[F.lit(mask ^ bit[d]) for d in chosen])
            shown = F.struct(*[(F.col(d) if mask & bit[d] else F.lit(None).cast(base.schema[d].dataType)).alias(d) for d in dims], F.lit(mask).alias("_mask"), cell(mask).alias("_cell"))
            offers.append(F.when(F.forall(smaller, lambda m: F.array_contains("_alive", m)), shown))
        offered = rows.withColumn("_offers", F.array_compact(F.array(*offers)))
        counted = offered.select(F.explode("_offers").alias("x"), "_n", "_t", "_c").groupBy(*[F.col(f"x.{c}").alias(c) for c in (*dims, "_mask", "_cell")]).agg(
            *[F.sum(c).alias(c) for c in ("_n", "_t", "_c")])
        level = settle(attach(counted, whole, "_all").where(F.col("_n") >= F.col("_all._n") * F.lit(support)).drop("_all"), "cells")
        out.append(level.select(*dims, "_mask", "_n", "_t", "_c"))
        found = level.agg(F.collect_list("_cell").alias("cells"))
        alive = F.transform(F.filter("_offers", lambda x: F.array_contains("_found.cells", x["_cell"])), lambda x: x["_mask"])
        rows = settle(attach(offered, found, "_found").withColumn("_alive", alive).where(F.size("_alive") > 0).select(*base.columns, "_alive"), "alive")
    cells = everything
    for level in out:
        cells = cells.union(level)
    return attach(cells, whole).select(
        *dims, (F.lit((1 << len(dims)) - 1) - F.col("_mask")).cast("long").alias("grouping"), F.col("_n").alias("n"), F.col("_t").alias("test"), F.col("_c").alias("control"),
        F.try_divide("_t", "_s._t").alias("test_share"), F.try_divide("_c", "_s._c").alias("control_share"), (F.col("_t") - F.col("_c")).alias("difference"))


def with_total(df: DataFrame, item: str, aggs: Sequence[Column], label: str = "TOTAL") -> DataFrame:
    """Aggregates per item with a totals row."""
    return df.rollup(item).agg(F.grouping(item).alias("_g"), *aggs).withColumn(
        item, F.when(F.col("_g") == 1, label).otherwise(F.col(item))).drop("_g")


def load_profile(df: DataFrame, split: Column, label: str) -> DataFrame:
    """Rows per split and label with the share inside the split."""
    c = df.groupBy(split.alias("split"), label).agg(F.count(F.lit(1)).alias("n"))
    # a handful of (split, label) rows
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))
