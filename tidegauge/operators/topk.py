"""Sorted reports, top-k, and set operations on row sets and columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordering import attach, running_sums
from tidegauge.operators.vectors import top_k_cosine


def by_size(df: DataFrame, column: str, tie: str) -> DataFrame:
    """Rows by descending absolute value (coefficients, scores)."""
    return df.orderBy(F.desc(F.abs(F.col(column))), tie)


def precision_lift_at(df: DataFrame, score: str, key: str, positive: Column, ns: Sequence[int] | None = None,
                      step: int | None = None) -> DataFrame:
    """precision@N, true positives and lift for the given N, or at every ``step`` ranks."""
    pos = positive.cast("long")
    base = df.agg(F.avg(pos).alias("rate"))
    r = running_sums(df, [-F.col(score), key], {"N": F.lit(1).cast("long"), "tp": pos})
    keep = F.col("N").isin(list(ns)) if ns is not None else F.col("N") % step == 0
    at = attach(r.where(keep).select("N", "tp"), base)
    prec = F.col("tp") / F.col("N")
    return at.select("N", "tp", prec.alias("precision"), F.try_divide(prec, F.col("_s.rate")).alias("lift"))


def best_rows(df: DataFrame, group: str, metric: str, columns: Sequence[str], tie: str) -> DataFrame:
    """Row with the largest metric per group; ties go to the smaller key."""
    return df.groupBy(group).agg(F.max_by(F.struct(*columns), F.struct(metric, -F.col(tie))).alias("_b")).select(group, "_b.*")


def nearest_by_distance(corpus: DataFrame, queries: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """Nearest neighbours by cosine distance, smaller first."""
    return top_k_cosine(queries, corpus, key, vec, k).withColumn("distance", 1 - F.col("score")).drop("score")


def top_overlap(a: DataFrame, b: DataFrame, item: str, score_a: Column, score_b: Column, k: int) -> DataFrame:
    """Items in both top-k lists."""
    ta = a.orderBy(score_a.desc(), item).limit(k).select(item)
    tb = b.orderBy(score_b.desc(), item).limit(k).select(item)
    return ta.join(tb, item, "left_semi")


def stack(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def votes(selections: DataFrame, feature: str, method: str, methods: Sequence[str]) -> DataFrame:
    """One column per selection method (1 when it chose the feature) and the number of votes."""
    wide = selections.select(feature, method).distinct().withColumn("_one", F.lit(1)).groupBy(feature).pivot(method, list(methods)).agg(F.max("_one"))
    wide = wide.na.fill(0)
    total = F.lit(0)
    for m in methods:
        total = total + F.col(m)
    return wide.withColumn("votes", total)
