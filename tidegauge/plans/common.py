"""Derived inputs shared by several queries, in Spark and as SQL text for the twins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.hashing import unit_hash


def u_sql(*keys: str, seed: int | str = 42) -> str:
    """SQL text of ``unit_hash`` (same number in both engines)."""
    parts = ",".join(f"({k})::VARCHAR" for k in keys)
    tail = f"({seed})::VARCHAR" if isinstance(seed, str) else f"'{seed}'"
    return f"(('0x'||substr(md5(concat_ws('|',{parts},{tail})),1,8))::BIGINT/4294967296.0::DOUBLE)"


def h_sql(*keys: str, seed: int | str = 42) -> str:
    parts = ",".join(f"({k})::VARCHAR" for k in keys)
    tail = f"({seed})::VARCHAR" if isinstance(seed, str) else f"'{seed}'"
    return f"(('0x'||substr(md5(concat_ws('|',{parts},{tail})),1,8))::BIGINT)"


LI_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LI_U = u_sql(*LI_KEYS)


def li_u(seed: int = 42) -> Column:
    return unit_hash(*LI_KEYS, seed=seed)


def with_geo(li: DataFrame) -> DataFrame:
    """Pickup and drop-off coordinates as fixed functions of part and supplier keys, inside the city box."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return li.withColumns({
        "lat1": F.lit(40.58) + ((p * 7919) % 3400).cast("double") / 10000,
        "lon1": F.lit(-74.26) + ((p * 104729) % 5100).cast("double") / 10000,
        "lat2": F.lit(40.58) + ((s * 6271) % 3400).cast("double") / 10000,
        "lon2": F.lit(-74.26) + ((s * 15485) % 5100).cast("double") / 10000,
    })


LI_GEO = """(select *, 40.58::DOUBLE+((l_partkey*7919)%3400)::DOUBLE/10000 lat1,
 -74.26::DOUBLE+((l_partkey*104729)%5100)::DOUBLE/10000 lon1,
 40.58::DOUBLE+((l_suppkey*6271)%3400)::DOUBLE/10000 lat2,
 -74.26::DOUBLE+((l_suppkey*15485)%5100)::DOUBLE/10000 lon2 from lineitem)"""


def labelled(spark, sf, table) -> DataFrame:
    """Labelled documents with a deterministic score: p = sigmoid of the log length, y = quality and toxic."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    z = (F.log(F.col("n_chars") + F.lit(1.0)) - F.lit(7.0)) * F.lit(0.8)
    p = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 4)
    p2 = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(0.5) * z - F.lit(1.0)))), 4)
    return table(spark, sf, "labels").join(d.withColumns({"z": z, "p": p, "p2": p2}), "doc_id")


LABELLED = """(select l.doc_id, quality, toxic, lang, source, n_chars, z, round(1.0::DOUBLE/(1.0::DOUBLE+exp(-z)),4) p,
 round(1.0::DOUBLE/(1.0::DOUBLE+exp(-(0.5::DOUBLE*z-1.0::DOUBLE))),4) p2 from labels l join
 (select *, (ln(n_chars+1.0::DOUBLE)-7.0::DOUBLE)*0.8::DOUBLE z from documents) d on l.doc_id=d.doc_id)"""

MONTHLY = """(select o_orderpriority series, date_trunc('month',o_orderdate) m,
 sum((o_totalprice*100)::BIGINT)::BIGINT/100.0::DOUBLE y from orders group by all)"""
DAILY = """(select event_type series, date_trunc('day',ts) d, sum(round(value*100)::BIGINT)::BIGINT/100.0::DOUBLE y
 from events group by all)"""


def cents(c: str) -> Column:
    """Exact integer cents of a two-digit amount, so that sums do not depend on order."""
    return F.round(F.col(c) * 100).cast("long")


def monthly(orders: DataFrame) -> DataFrame:
    """Monthly order value per priority: (series, m, y)."""
    return orders.groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m")).agg(
        (F.sum(cents("o_totalprice")) / F.lit(100.0)).alias("y")
    )


def daily(events: DataFrame) -> DataFrame:
    """Daily event value per type: (series, d, y)."""
    return events.groupBy(F.col("event_type").alias("series"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d")).agg(
        (F.sum(cents("value")) / F.lit(100.0)).alias("y")
    )
