"""Drift reports, retrain triggers, promotion gates, label coverage and snapshots."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalar import psi_label
from tidegauge.operators.stats import ks, psi
from tidegauge.operators.windows import first_breach
from tidegauge.session import settle


def drift_report(df: DataFrame, is_reference: Column, value: str, stream: str, week: str, label: str, pred: str) -> DataFrame:
    """Per (stream, week): PSI and KS against the stream's fixed reference, accuracy and predicted-positive rate."""
    slim = settle(df.select(stream, week, value, label, pred, is_reference.alias("_ref")), "drift-input")
    ref = slim.where("_ref")
    a = psi(ref, slim, value, [stream], [week])
    b = ks(ref, slim, value, [stream], [week]).select(stream, week, F.col("d").alias("ks_d"), F.col("p").alias("ks_p"))
    c = slim.groupBy(stream, week).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"), F.avg(F.col(pred).cast("double")).alias("pred_positive_rate"))
    out = a.join(b, [stream, week]).join(c, [stream, week])
    return out.withColumn("status", psi_label(F.col("psi")))


def retrain_trigger(report: DataFrame, stream: str, week: str, baseline: DataFrame, psi_limit: float = 0.25, drop: float = 0.10, sustained: int = 2) -> DataFrame:
    """First week each rule fires, and the first sustained breach. ``baseline``: accuracy per stream as ``base``."""
    r = report.join(baseline, stream)
    psi_hit, acc_hit = F.col("psi") >= psi_limit, F.col("accuracy") < F.col("base") - drop
    first = lambda c: F.min(F.when(c, F.col(week)))
    g = r.groupBy(stream).agg(first(psi_hit).alias("psi_week"), first(acc_hit).alias("accuracy_week"))
    s = first_breach(r, stream, week, psi_hit | acc_hit, sustained)
    return g.join(s, stream).withColumn("retrain", F.col("first_week").isNotNull())


def promotion_gate(scored: DataFrame, sets: str, label: str, champion: str, challenger: str) -> DataFrame:
    """Promote only if the challenger is at least as accurate on every evaluation set."""
    acc = lambda c: F.avg((F.col(c) == F.col(label)).cast("double"))
    per = scored.groupBy(sets).agg(F.count(F.lit(1)).alias("n"), acc(champion).alias("champion"), acc(challenger).alias("challenger"))
    return per.agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("n"), F.every(F.col("challenger") >= F.col("champion")).alias("promote"), F.min(F.col("challenger") - F.col("champion")).alias("worst_gain"))


def label_coverage(predictions: DataFrame, labels: DataFrame, key: str, period: str, label: str, pred: str) -> DataFrame:
    """Share of predictions with a label, and accuracy on the labelled ones only."""
    j = predictions.join(labels.select(key, label), key, "left")
    return j.groupBy(period).agg(F.count(F.lit(1)).alias("predictions"), F.count(label).alias("labelled"), (F.count(label) / F.count(F.lit(1))).alias("coverage"),
                                 F.avg(F.when(F.col(label).isNotNull(), (F.col(label) == F.col(pred)).cast("double"))).alias("accuracy"))


def freeze(df: DataFrame, root: str, name: str, date: str) -> str:
    """Write-once snapshot by date; freezing it again fails."""
    path = f"{root}/{name}/date={date}"
    df.write.mode("errorifexists").parquet(path)
    return path


def frozen(spark: SparkSession, root: str, name: str, date: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/date={date}")


def freeze_once(df: DataFrame, root: str, name: str, date: str) -> DataFrame:
    """Freeze unless the snapshot exists; returns the frozen rows either way."""
    try:
        freeze(df, root, name, date)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    return frozen(df.sparkSession, root, name, date)
