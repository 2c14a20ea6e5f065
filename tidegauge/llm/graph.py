"""Connected components of an edge table, by least labels with pointer jumping; each round is a written table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges(u, v)``: the least vertex of its component.

    Rounds grow with the logarithm of the longest path. A vertex of very many edges is a skewed key of plain joins with
    one row per vertex on the other side, and of a grouping with partial aggregation. Loops and repeated edges do no
    harm; no edges give no rows. Rounds are read back from the shared folder, so a lost executor costs no earlier round.
    """
    both = settle(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = settle(both.groupBy(F.col("u").alias("v")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        # the least label next to a vertex is proposed to the vertex and to the vertex that names its label
        heard = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("label").alias("m"))
        told = labels.join(heard, "v").select("v", "label", F.least("label", "m").alias("m"))
        best = told.select("v", "m").union(told.select(F.col("label").alias("v"), "m")).groupBy("v").agg(F.min("m").alias("m"))
        up = best.select(F.col("v").alias("m"), F.col("m").alias("above"))
        new = settle(best.join(up, "m").select("v", F.least("m", "above").alias("label")), "labels")
        moved = new.join(labels.withColumnRenamed("label", "old"), "v").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels
