"""Order-dependent work without a single-task sort.

A window without a partition, or with one hot partition, sorts in one task. Here rows first get an
order bucket: split points come from a bounded sample of the keys (a count and a sample run when the
operator is called), so a hot group is cut into many buckets. Windows run inside a bucket; what earlier buckets contribute is a small table with one row
per (group, bucket). The sample only steers balance, never the result.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression; Catalyst would otherwise paste it wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def attach(df: DataFrame, one_row: DataFrame, name: str = "_s") -> DataFrame:
    """Put a one-row aggregate beside every row, as a struct column from a scalar subquery; no such row is an error."""
    row = one_row.select(F.struct(*[F.col(c) for c in one_row.columns])).scalar()
    return df.withColumn(name, F.coalesce(row, F.raise_error(F.lit("the one-row table is empty"))))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named keys where null matches null; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


SAMPLE_PER_BUCKET = 32


def bucket_target(df: DataFrame) -> int:
    """Number of order buckets; it follows the session's shuffle width, so it grows with the data the session is set up for."""
    return max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, names: Sequence[str], n: int) -> list[Row]:
    """At most ``n - 1`` increasing key tuples from a sample of about 32 rows per bucket; dates and plain timestamps as text."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keys = df.select(*names)
    share = min(1.0, SAMPLE_PER_BUCKET * n / max(keys.count(), 1))
    picked = keys.sample(fraction=share, seed=42) if share < 1.0 else keys
    text = [F.col(c).cast("string").alias(c) if kinds[c] in ("timestamp_ntz", "date") else F.col(c) for c in names]
    sample = picked.orderBy(*names).select(*text).collect()  # bounded by 32 n rows
    out = []
    for i in range(1, n):
        if len(sample) * i // n < len(sample):
            point = sample[len(sample) * i // n]
            if not out or out[-1] != point:
                out.append(point)
    return out


def order_buckets(df: DataFrame, key: Sequence[Column | str], name: str = "_b", n: int | None = None) -> DataFrame:
    """Add an int column that is non-decreasing in the sort key (group columns first, then order).

    The split points are fixed before the plan is built, so all its branches agree on the buckets: they are one
    literal array, and a row finds its bucket by binary search (nulls first, as in Spark's order).
    """
    n = n or bucket_target(df)
    names = [f"_k{i}" for i in range(len(key))]
    cols = [as_col(c) for c in key]
    types = df.select(*[c.alias(x) for c, x in zip(cols, names)]).schema
    # a zoned timestamp is compared by its microseconds: its text repeats when clocks go back
    cols = [F.unix_micros(c) if f.dataType.simpleString() == "timestamp" else c for c, f in zip(cols, types.fields)]
    keyed = df.withColumns(dict(zip(names, cols)))
    points = split_points(keyed, names, n)
    if not points:
        return keyed.withColumn(name, F.lit(0)).drop(*names)
    kinds = {f.name: f.dataType for f in keyed.select(*names).schema.fields}
    edges = F.array(*[F.struct(*[F.lit(p[c]).cast(kinds[c]).alias(c) for c in names]) for p in points])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(points).bit_length()))])
    here = F.struct(*[F.col(c) for c in names])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(edges, at + step - 1) <= here, F.lit(False)), at + step).otherwise(at))
    return keyed.withColumn(name, found).drop(*names)


def running_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: dict[str, Column | str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Inclusive cumulative sums in ``order`` within ``by``, for groups of any size.

    ``order`` must identify a row within its group; write a descending numeric key with a minus sign.
    """
    by = list(by)
    for i, c in enumerate(order):
        df = df.withColumn(f"_o{i}", as_col(c))
    ocols = [f"_o{i}" for i in range(len(order))]
    for i, c in enumerate(sums.values()):
        df = df.withColumn(f"_v{i}", as_col(c))
    b = order_buckets(df, [*by, *ocols])
    outs = list(sums)
    totals = b.groupBy(*by, "_b").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(outs))])
    order_b = Window.partitionBy(*by).orderBy("_b")
    before = order_b.rowsBetween(Window.unboundedPreceding, -1)
    # only a bucket that starts in the middle of a group has earlier rows: one row per bucket at most
    offsets = totals.select(
        *by, "_b", F.row_number().over(order_b).alias("_nth"),
        *[F.sum(f"_t{i}").over(before).alias(f"_off{i}") for i in range(len(outs))],
    ).where("_nth > 1").drop("_nth")
    inside = Window.partitionBy(*by, "_b").orderBy(*ocols).rowsBetween(Window.unboundedPreceding, 0)
    out = same(b, F.broadcast(offsets), [*by, "_b"], "left")
    out = out.withColumns(
        {o: F.coalesce(F.col(f"_off{i}"), F.lit(0)) + F.coalesce(F.sum(f"_v{i}").over(inside), F.lit(0)) for i, o in enumerate(outs)}
    )
    return out.drop("_b", *ocols, *[f"_v{i}" for i in range(len(outs))], *[f"_off{i}" for i in range(len(outs))])


def row_numbers(df: DataFrame, order: Sequence[Column | str], name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """``row_number()`` in ``order`` within ``by`` without a single sorting task."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, by)


def carry_last(
    df: DataFrame, order: Sequence[Column | str], values: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Newest non-null value up to and including each row, in ``order`` within ``by``.

    ``values`` maps a value column to the name of its carried copy; all share one ordered pass.
    """
    by = list(by)
    for i, c in enumerate(order):
        df = df.withColumn(f"_o{i}", as_col(c))
    ocols = [f"_o{i}" for i in range(len(order))]
    b = order_buckets(df, [*by, *ocols])
    ends = b.groupBy(*by, "_b").agg(*[
        F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*ocols))).alias(f"_end{i}") for i, v in enumerate(values)
    ])
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per bucket: the group that began in an earlier one
    carried = ends.select(
        *by, "_b", F.count(F.lit(1)).over(before).alias("_nth"),
        *[F.last(f"_end{i}", ignorenulls=True).over(before).alias(f"_in{i}") for i in range(len(values))],
    ).where("_nth > 0").drop("_nth")
    inside = Window.partitionBy(*by, "_b").orderBy(*ocols).rowsBetween(Window.unboundedPreceding, 0)
    out = same(b, F.broadcast(carried), [*by, "_b"], "left")
    out = out.withColumns({
        name: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_in{i}")) for i, (v, name) in enumerate(values.items())
    })
    return out.drop("_b", *ocols, *[f"_in{i}" for i in range(len(values))])


def exact_quantiles(
    df: DataFrame, value: Column | str, probs: Sequence[float], by: Sequence[str] = (), name: str = "q",
) -> DataFrame:
    """Exact linearly interpolated quantiles per group: one row with an array ``q`` and the count ``n``.

    The data are counted per bucket first; only buckets that hold a wanted rank are then sorted, after
    equal values were counted together. No task ever holds a whole group.
    """
    by, probs = list(by), list(probs)
    v = df.select(*by, as_col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    b = order_buckets(v, [*by, "_v"])
    counts = b.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_hi", F.sum("_c").over(upto)).withColumn(
        "n", F.sum("_c").over(Window.partitionBy(*by))
    )
    pos = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(p) for p in pos for f in (F.floor, F.ceil)]))
    lo = F.col("_hi") - F.col("_c")
    wanted = counts.select(
        *by, "_b", "n", lo.alias("_lo"),
        F.filter(ranks, lambda r: (r >= lo) & (r < F.col("_hi"))).alias("_ranks"),
    ).where(F.size("_ranks") > 0)
    # at most two buckets per group and probability
    cand = same(b, wanted, [*by, "_b"]).groupBy(*by, "_b", "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_lo").alias("_lo"), F.max("n").alias("n"), F.max("_ranks").alias("_ranks")
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("_in", F.sum("_c").over(inside))
    cand = cand.withColumn("_cum", F.col("_in") + F.col("_lo"))
    hits = cand.select(
        *by, "n", "_v",
        F.explode(F.filter("_ranks", lambda r: (r >= F.col("_cum") - F.col("_c")) & (r < F.col("_cum")))).alias("_r"),
    )
    # at most two ranks per wanted probability
    rows = hits.groupBy(*by).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m")
    )
    def at(p: Column) -> Column:
        low, high = F.col("_m")[F.floor(p)], F.col("_m")[F.ceil(p)]
        return low + (high - low) * (p - F.floor(p))
    return rows.select(*by, "n", F.array(*[at(p) for p in pos]).alias(name))
