"""Connected components of an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import settle


def connected(edges: DataFrame) -> DataFrame:
    """(v, c) for each vertex of ``edges(u, v)``: ``c`` is the least vertex that can be reached.

    Every round a vertex takes the least label among its neighbours, hands it to the vertex it was named after, and follows the name of its new
    label one step further. Rounds grow with the logarithm of a path's length. Each one is written, so that a lost executor costs one round.
    """
    near = settle(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "neighbours")
    named = settle(near.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("v"), F.least("u", "least").alias("c")), "names")
    while True:
        offers = near.join(named, "v").select(F.col("u").alias("v"), "c")
        lower = offers.unionByName(named).groupBy("v").agg(F.min("c").alias("to"))
        handed = lower.join(named, "v").select(F.col("c").alias("v"), "to").unionByName(lower).groupBy("v").agg(F.min("to").alias("to"))
        step = handed.join(handed.select(F.col("v").alias("to"), F.col("to").alias("next")), "to").select("v", F.least("to", "next").alias("c"))
        new = settle(step, "names")
        if new.join(named.withColumnRenamed("c", "was"), "v").where("c <> was").isEmpty():
            return new
        named = new
