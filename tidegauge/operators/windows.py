"""Lags, rolling and cumulative values, decomposition, runs.

Series operators expect one row per period and series (aggregate raw rows first), so a window holds at
most one series' periods.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordering import row_numbers, running_sums


def lag_features(df: DataFrame, series: str, t: str, y: str, n: int) -> DataFrame:
    """lag_1..lag_n; rows without full history are dropped."""
    w = Window.partitionBy(series).orderBy(t)
    out = df.withColumns({f"lag_{k}": F.lag(y, k).over(w) for k in range(1, n + 1)})
    return out.na.drop(subset=[f"lag_{k}" for k in range(1, n + 1)])


def differences(df: DataFrame, series: str, t: str, y: str) -> DataFrame:
    w = Window.partitionBy(series).orderBy(t)
    d1 = df.withColumn("diff_1", F.col(y) - F.lag(y, 1).over(w))
    return d1.withColumn("diff_2", F.col("diff_1") - F.lag("diff_1", 1).over(w))


def sliding_arrays(df: DataFrame, series: str, t: str, y: str, n: int) -> DataFrame:
    """The previous ``n`` values as an array beside the value they predict."""
    w = Window.partitionBy(series).orderBy(t).rowsBetween(-n, -1)
    return df.withColumn("window", F.collect_list(y).over(w)).where(F.size("window") == n)


def rolling_mean(df: DataFrame, series: str, t: str, y: str, n: int) -> DataFrame:
    w = Window.partitionBy(series).orderBy(t).rowsBetween(-(n - 1), 0)
    return df.withColumn("_n", F.count(y).over(w)).withColumn("rolling", F.avg(y).over(w)).where(F.col("_n") == n).drop("_n")


def running_mean(df: DataFrame, order: Sequence[Column | str], x: Column) -> DataFrame:
    """Mean of all rows so far, over the whole table without one sorting task."""
    out = running_sums(df, order, {"_sum": x, "seen": F.lit(1).cast("long")})
    return out.withColumn("running_mean", F.col("_sum") / F.col("seen")).drop("_sum")


def ranked_precision_recall(df: DataFrame, score: str, key: str, positive: Column) -> DataFrame:
    """Rank by descending score with cumulative tp, fp, precision and recall."""
    from tidegauge.operators.ordering import attach

    pos = positive.cast("long")
    total = df.agg(F.sum(pos).alias("p"))
    r = running_sums(df, [-F.col(score), key], {"rank": F.lit(1).cast("long"), "tp": pos})
    return attach(r, total).withColumns({
        "fp": F.col("rank") - F.col("tp"), "precision": F.col("tp") / F.col("rank"),
        "recall": F.try_divide(F.col("tp"), F.col("_s.p"))}).drop("_s")


def leaderboard(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    return row_numbers(df, order, "place")


def decompose(df: DataFrame, series: str, t: str, y: str, phase: Column, period: int = 12) -> DataFrame:
    """Additive decomposition: centred 2 x period average, phase means recentred to zero, residual."""
    h = period // 2
    w = Window.partitionBy(series).orderBy(t)
    frame = w.rowsBetween(-h, h)
    # half weights at the two ends
    total = F.sum(y).over(frame) - (F.lag(y, h).over(w) + F.lead(y, h).over(w)) / 2
    trend = F.when(F.count(y).over(frame) == 2 * h + 1, total / period)
    d = df.withColumn("trend", trend).withColumn("_phase", phase)
    means = d.where(F.col("trend").isNotNull()).groupBy(series, "_phase").agg(F.avg(F.col(y) - F.col("trend")).alias("_m"))
    seasonal = means.withColumn("seasonal", F.col("_m") - F.avg("_m").over(Window.partitionBy(series))).drop("_m")
    return d.join(seasonal, [series, "_phase"], "left").withColumn(
        "resid", F.col(y) - F.col("trend") - F.col("seasonal")).drop("_phase")


def section_flags(df: DataFrame, key: str, text: str, separator: str) -> DataFrame:
    """Lines of each document with a flag for those between an odd and the next even separator line."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    sep = F.col("line").rlike(separator)
    w = Window.partitionBy(key).orderBy("line_no")  # one document's lines
    return lines.withColumn("in_section", (F.sum(sep.cast("int")).over(w) % 2 == 1) & ~sep)


def first_breach(df: DataFrame, stream: str, week: str, breach: Column, sustained: int = 2) -> DataFrame:
    """First breaching week per stream, and the first week that ends ``sustained`` breaches in a row."""
    w = Window.partitionBy(stream).orderBy(week)
    d = df.withColumn("_b", F.coalesce(breach, F.lit(False)))
    run = F.sum(F.col("_b").cast("int")).over(w.rowsBetween(-(sustained - 1), 0))
    full = F.count(F.lit(1)).over(w.rowsBetween(-(sustained - 1), 0))
    d = d.withColumn("_run", (run == sustained) & (full == sustained))
    return d.groupBy(stream).agg(
        F.min(F.when(F.col("_b"), F.col(week))).alias("first_week"),
        F.min(F.when(F.col("_run"), F.col(week))).alias("sustained_week"))


def turn_order(df: DataFrame, debate: str, turn: str, speaker: str, text: str) -> DataFrame:
    """Turn number with how much history precedes it (statements and characters).

    The history of a turn is the earlier rows of its debate; ``history`` reads it for one turn. Copying
    it into every row would grow with the square of the debate.
    """
    out = running_sums(df, [turn], {"seq": F.lit(1).cast("long"), "_chars": F.length(text).cast("long")}, [debate])
    return out.select(debate, turn, speaker, "seq", (F.col("seq") - 1).alias("statements_before"),
                      (F.col("_chars") - F.length(text)).alias("chars_before"))


def history(df: DataFrame, debate: str, turn: str, which, before) -> DataFrame:
    return df.where((F.col(debate) == F.lit(which)) & (F.col(turn) < F.lit(before))).orderBy(turn)
