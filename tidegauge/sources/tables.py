"""Reading, writing and keyed loading of tables (Parquet, CSV, JSON-Lines)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import scratch


def write_features(df: DataFrame, path: str, timestamp_field: str) -> str:
    """Feature table as Parquet partitioned by event day, so that a time range prunes folders."""
    # AQE splits a hot day over several writers
    day = F.to_date(timestamp_field).alias("day")
    df.withColumn("day", day).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)
    return path


def read_features(spark: SparkSession, path: str, timestamp_field: str, start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """Feature rows with event time in [start, end]; the day folders outside it are not listed."""
    df = spark.read.parquet(path)
    if start:
        df = df.where((F.col("day") >= F.to_date(F.lit(start))) & (F.col(timestamp_field) >= F.lit(start).cast("timestamp_ntz")))
    if end:
        df = df.where((F.col("day") <= F.to_date(F.lit(end))) & (F.col(timestamp_field) <= F.lit(end).cast("timestamp_ntz")))
    return df.drop("day")


def csv_round_trip(df: DataFrame, path: str) -> DataFrame:
    """Result table to CSV with a header, read back under its own schema."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def jsonl_round_trip(df: DataFrame, path: str) -> DataFrame:
    """One JSON object per line, read back under the declared schema."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def checked_vectors(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Fail the job when a stored vector does not have the declared dimension."""
    bad = F.raise_error(F.concat(F.lit(f"{column}: dimension is not {dim} but "), F.size(column).cast("string")))
    return df.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(bad.cast(df.schema[column].dataType)))


def declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema; a null in a NOT NULL column fails the job."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"null in {f.name}")).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def describe_entities(tables: dict[str, DataFrame], asked: Sequence[str]) -> DataFrame:
    """Columns and current row count per asked entity; an unknown one gives an error row."""
    out = None
    for name in asked:
        if name in tables:
            row = tables[name].agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("entity"),
                F.lit(",".join(tables[name].columns)).alias("columns"),
                "row_count",
                F.lit(None).cast("string").alias("error"),
            )
        else:
            spark = next(iter(tables.values())).sparkSession
            row = spark.range(1).select(
                F.lit(name).alias("entity"), F.lit(None).cast("string").alias("columns"),
                F.lit(None).cast("long").alias("row_count"), F.lit("unknown entity").alias("error"),
            )
        out = row if out is None else out.unionByName(row)
    return out


def classify_load(incoming: DataFrame, stored_keys: DataFrame, key: str, seq: str, valid: Column) -> DataFrame:
    """Status per incoming row: rejected, duplicate, or inserted.

    The first valid row of a key wins, unless the store has the key. Winners come from a pre-aggregation
    and are matched back on (key, seq), so a key that is replayed many times does not gather anywhere.
    """
    rows = incoming.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    winners = rows.where("_ok").groupBy(key).agg(F.min(seq).alias(seq))
    fresh = winners.join(stored_keys.select(key).distinct(), key, "left_anti").withColumn("_new", F.lit(True))
    return rows.join(fresh, [key, seq], "left").withColumn(
        "status",
        F.when(~F.col("_ok"), "rejected").when(F.col("_new"), "inserted").otherwise("duplicate"),
    ).drop("_ok", "_new")


def append_once(incoming: DataFrame, store_path: str, key: str, seq: str, valid: Column) -> DataFrame:
    """Idempotent append to a Parquet store; returns the status of each incoming row.

    Statuses are written before the append, because reading the store again afterwards would call
    every row a duplicate.
    """
    spark = incoming.sparkSession
    stored = spark.read.parquet(store_path)
    path = scratch(spark, "load-status")
    classify_load(incoming, stored, key, seq, valid).write.parquet(path)
    status = spark.read.parquet(path)
    status.where("status = 'inserted'").select(*stored.columns).write.mode("append").parquet(store_path)
    return status


def nest_children(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Parents with all their children nested in order (``order``, then the fields); null without children.

    One parent is one row, so its children meet in one task: where a parent may have more of them than fit a row, read the
    children as rows instead.
    """
    item = F.struct(F.struct(*order, *fields).alias("_pos"), *fields)
    return parents.join(children.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items")), key, "left")
