"""Mutual information of numeric features and a label from neighbour distances, all on order buckets."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.aggregates import long_form
from tidegauge.operators.ordering import order_buckets
from tidegauge.session import settle

#: Distinct (class, value) rows of an order bucket, and buckets of a cell, which one task reads at once.
BUCKET_ROWS = 1 << 15
CELL = 8


def digamma(x: float) -> float:
    """Derivative of log gamma for x > 0: recurrence up to 12, then the asymptotic series."""
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _cell_ranks(k: int, label: T.DataType) -> tuple[Callable, T.StructType]:
    """What one cell (all classes' values in a range, with counts) settles by itself, and the rows it can't.

    kind 0: counts of each m, class size and k of settled rows; 1: rows whose interval leaves the cell, with radius, or null where the cell may not
    hold the row's neighbours; 2: the first and last 2 k rows of each class, from which those radii are found.
    """
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("what", T.StringType()), T.StructField("value", T.LongType()),
                           T.StructField("c", T.LongType()), T.StructField("_y", label), T.StructField("x", T.DoubleType()), T.StructField("_n", T.LongType()), T.StructField("r", T.DoubleType())])

    def ranks(cell: pa.Table) -> pa.Table:
        cell = cell.select(["feature", "_y", "x", "c", "_n"]).combine_chunks()
        y = cell["_y"].combine_chunks().dictionary_encode()
        y = (y.combine_chunks() if isinstance(y, pa.ChunkedArray) else y).indices.to_numpy()
        by_class = np.lexsort((cell["x"].to_numpy(), y))
        cell, y = cell.take(pa.array(by_class)), y[by_class]
        x, c, n = (cell[q].to_numpy() for q in ("x", "c", "_n"))
        order = np.argsort(x, kind="stable")
        values, upto = x[order], np.concatenate([[0], np.cumsum(c[order])])
        used = np.minimum(k, n - 1)
        missing = used - (c - 1)  # neighbours of other value that the radius needs
        size = len(x)
        far = np.full((2 * k, size), np.inf)
        there = np.zeros((2 * k, size), np.int64)
        for d in range(1, k + 1):
            same = y[d:] == y[:-d]
            step = np.where(same, np.abs(x[d:] - x[:-d]), np.inf)
            far[d - 1, d:], there[d - 1, d:] = step, np.where(same, c[:-d], 0)
            far[k + d - 1, :size - d], there[k + d - 1, :size - d] = step, np.where(same, c[d:], 0)
        at = np.argsort(far, axis=0, kind="stable")
        enough = np.cumsum(np.take_along_axis(there, at, 0), axis=0) >= missing
        r = np.where(enough.any(axis=0), np.take_along_axis(far, np.take_along_axis(at, enough.argmax(axis=0)[None], 0), 0)[0], np.inf)
        r = np.where(missing <= 0, 0.0, r)
        here = (r == 0) | ((r <= x - values[0]) & (r <= values[-1] - x))
        inner = np.where(here, r * (1 - 1e-7), 0.0)
        low = np.where(r == 0, np.searchsorted(values, x, "left"), np.searchsorted(values, x - inner, "right"))
        high = np.where(r == 0, np.searchsorted(values, x, "right"), np.searchsorted(values, x + inner, "left"))
        out = []
        feature = cell["feature"][0].as_py()
        for what, value in (("m", upto[high] - upto[low]), ("_n", n), ("k", used)):
            one, code = np.unique(value[here], return_inverse=True)
            weight = np.zeros(len(one), np.int64)
            np.add.at(weight, code, c[here])
            out.append(pa.table({"kind": np.zeros(len(one), np.int32), "what": pa.array([what] * len(one), pa.string()), "value": one, "c": weight}))
        first = np.concatenate([[0], np.flatnonzero(y[1:] != y[:-1]) + 1])
        count = np.diff(np.append(first, size))
        place = np.arange(size) - np.repeat(first, count)
        back = np.repeat(count, count) - 1 - place
        whole = (place >= k) & (back >= k)
        edge = (place < 2 * k) | (back < 2 * k)
        for kind, rows in ((1, ~here), (2, edge)):
            z = np.flatnonzero(rows)
            some = cell.take(pa.array(z))
            # an edge row carries its radius as null only if it asks for it
            radius = pa.array(r[z], mask=~whole[z]) if kind == 1 else pa.array(np.zeros(len(z)), mask=(~here & ~whole)[z])
            if kind == 1:
                z = whole[z]
                some, radius = some.filter(pa.array(z)), radius.filter(pa.array(z))
            out.append(some.select(["_y", "x", "c", "_n"]).append_column("r", radius).append_column("kind", pa.array(np.full(some.num_rows, kind, np.int32))))
        t = pa.concat_tables(out, promote_options="default")
        t = t.append_column("feature", pa.array([feature] * t.num_rows, pa.string()))
        return t.select([f.name for f in schema])

    return ranks, schema


def neighbour_information(df: DataFrame, key: Sequence[str], label: str, features: Sequence[str], k: int = 3) -> DataFrame:
    """(feature, mi) by the estimator of Ross: digamma(n) + mean digamma(k) - mean digamma(class size) - mean digamma(m), never below 0.

    A row's radius is the distance to its ``k``-th nearest other row of its class (the farthest of the class, if it has fewer); m counts the rows of
    all classes nearer than that, the row itself included. Where ties make the radius 0, m counts the equal rows. Distances that differ
    by less than a ten-millionth of the radius are equal. Rows with a null label or a null, NaN feature take no part in that feature, nor do
    classes of one row. Rows of equal class and value are counted together, so ``key`` decides nothing.

    Rows go to order buckets of (feature, value); a cell of neighbouring buckets settles every row whose interval lies inside it, by binary search.
    The others (at a cell's ends, or of rare classes) find their neighbours among the first and last rows of their class in each cell, and their
    ranks by one ordered pass over the buckets in which their intervals end. No step holds a class or a feature in one task.
    """
    long = long_form(df.where(F.col(label).isNotNull()), features, [F.col(label).alias("_y")], "feature", "x").where("x is not null and not isnan(x)")
    values = settle(long.groupBy("feature", "_y", "x").agg(F.count(F.lit(1)).alias("c")), "values")
    sizes = values.groupBy("feature", "_y").agg(F.sum("c").alias("_n")).where("_n > 1")
    at = order_buckets(values, ["feature", "x"], "_b", max(8, -(-values.count() // BUCKET_ROWS)))
    at = settle(at.join(sizes, ["feature", "_y"]), "buckets")
    ranks, schema = _cell_ranks(k, at.schema["_y"].dataType)
    found = settle(at.withColumn("_cell", F.expr(f"_b div {CELL}")).groupBy("feature", "_cell").applyInArrow(ranks, schema), "cells")

    # radii of rows at a cell's ends: one row has at most 2 k + 1 others beside it, a class 4 k rows a cell
    used = F.least(F.lit(k).cast("long"), F.col("_n") - 1)
    beside = F.collect_list(F.struct("x", F.least("c", F.lit(k + 1).cast("long")).cast("int").alias("c"))).over(Window.partitionBy("feature", "_y").orderBy("x").rowsBetween(-k, k))
    distances = F.flatten(F.transform("_near", lambda o: F.array_repeat(F.when(o["x"] == F.col("x"), F.lit(0.0)).otherwise(F.abs(o["x"] - F.col("x"))), o["c"])))
    asked = found.where("kind = 2").withColumn("_near", beside).where("r is null").withColumn("r", F.get(F.array_sort(distances), used.cast("int")))
    rows = ["feature", "x", "c", "_n", "r"]
    open_rows = settle(found.where("kind = 1").select(*rows).unionByName(asked.select(*rows)).withColumns({"k": used, "id": F.monotonically_increasing_id()}), "open")

    # the lower end leaves out what lies at or below it, the upper end takes what lies below it
    inner = F.col("r") * (1 - 1e-7)
    low = F.struct((F.col("x") - inner).alias("v"), F.lit(2).alias("kind"), F.lit(-1).alias("sign"))
    high = F.struct((F.col("x") + inner).alias("v"), F.lit(0).alias("kind"), F.lit(1).alias("sign"))
    upto = Window.partitionBy("feature").orderBy("_b")
    buckets = at.groupBy("feature", "_b").agg(F.min("x").alias("lo"), F.sum("c").alias("_c"))
    buckets = buckets.select("feature", "_b", "lo", F.lead("lo").over(upto).alias("next"), (F.sum("_c").over(upto) - F.col("_c")).alias("before"))  # one row a bucket
    ends = open_rows.select("feature", "id", F.inline(F.array(low, high))).alias("e")
    inside = (F.col("e.feature") == F.col("t.feature")) & (F.col("v") >= F.col("lo")) & (F.col("next").isNull() | (F.col("v") < F.col("next")))
    ends = settle(ends.join(F.broadcast(buckets.alias("t")), inside, "left").select("e.*", "_b", F.coalesce("before", F.lit(0)).alias("before")), "ends")
    hit = F.broadcast(ends.select("feature", "_b").distinct())
    points = at.join(hit, ["feature", "_b"], "left_semi").select("feature", "_b", F.col("x").alias("v"), F.lit(1).alias("kind"), F.col("c").alias("here"))
    marks = points.unionByName(ends.withColumn("here", F.lit(0).cast("long")), allowMissingColumns=True)
    below = F.sum("here").over(Window.partitionBy("feature", "_b").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0))
    m = marks.withColumn("below", below).where("id is not null").groupBy("id").agg(F.sum(F.col("sign") * (F.col("before") + F.col("below"))).alias("m"))
    late = open_rows.join(m, "id").unpivot(["feature", "c"], ["m", "_n", "k"], "what", "value")
    counted = found.where("kind = 0").select("feature", "what", "value", "c").unionByName(late).groupBy("feature", "what", "value").agg(F.sum("c").alias("c"))

    def psi(batches):
        for b in batches:
            yield pd.DataFrame({"feature": b["feature"], "what": b["what"], "c": b["c"], "t": [c * digamma(v) for v, c in zip(b["value"], b["c"])]})

    terms = counted.mapInPandas(psi, "feature string, what string, c long, t double")  # one evaluation for each distinct count
    signed = F.when(F.col("what") == "k", F.col("t")).otherwise(-F.col("t"))
    per = terms.groupBy("feature").agg(F.sum(signed).alias("s"), F.sum(F.when(F.col("what") == "k", F.col("c"))).alias("n"))

    def finish(batches):
        for b in batches:
            yield pd.DataFrame({"feature": b["feature"], "mi": [max(0.0, digamma(n) + s / n) for s, n in zip(b["s"], b["n"])]})

    return per.mapInPandas(finish, "feature string, mi double")
