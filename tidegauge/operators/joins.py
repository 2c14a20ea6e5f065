"""Joins beyond plain equality: point in time, nearest in one dimension, audits."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordering import attach, carry_last, row_numbers, running_sums
from tidegauge.session import settle


@dataclass(frozen=True)
class FeatureView:
    """A table of feature values: entity key, event time, time to live and the served columns."""

    table: DataFrame
    key: str
    ts: str
    columns: Sequence[str]
    ttl_seconds: int | None = None
    created: str | None = None
    name: str = "view"


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def point_in_time(entities: DataFrame, views: Sequence[FeatureView], entity_ts: str) -> DataFrame:
    """Backward as-of join: per view the newest feature row at or before each entity row, inside its ttl.

    Entity rows and the rows of all views of one key are stacked and the last feature of each view is
    carried forward, so the cost is one ordered pass; a range join would emit every earlier feature row
    for every entity row. Order buckets split an entity that owns a large share of the rows. Entity rows
    without a match stay, with nulls.
    """
    key = views[0].key
    if any(v.key != key for v in views):
        raise ValueError("one pass serves the views of one entity key; call once per key")
    feats = [F.struct(F.col(v.ts).alias("_fts"), *v.columns) for v in views]
    blank = [F.lit(None).alias(f"_feat{i}") for i in range(len(views))]
    stack = entities.select(
        F.col(key), F.col(entity_ts).alias("_ts"), F.lit(len(views)).alias("_side"), F.lit(None).cast("long").alias("_tie"),
        F.struct(*entities.columns).alias("_row"), *blank,
    )
    for i, v in enumerate(views):
        tie = F.col(v.created).cast("long") if v.created else F.lit(0).cast("long")
        mine = [feats[i].alias(f"_feat{i}") if i == j else b for j, b in enumerate(blank)]
        stack = stack.unionByName(v.table.select(
            F.col(v.key).alias(key), F.col(v.ts).alias("_ts"), F.lit(i).alias("_side"), tie.alias("_tie"), F.lit(None).alias("_row"), *mine))
    last = carry_last(stack, ["_ts", "_side", "_tie"], {f"_feat{i}": f"_last{i}" for i in range(len(views))}, [key])
    cols = []
    for i, v in enumerate(views):
        hit = F.col(f"_last{i}").isNotNull()
        if v.ttl_seconds is not None:
            hit = hit & (_micros(F.col("_ts")) - _micros(F.col(f"_last{i}._fts")) <= F.lit(v.ttl_seconds * 1_000_000))
        cols += [F.when(hit, F.col(f"_last{i}.{c}")).alias(f"{v.name}__{c}") for c in v.columns]
    return last.where(F.col("_side") == len(views)).select("_row.*", *cols)


def latest_per_key(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Newest row per key by partial aggregation (a hot key is combined before the shuffle)."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return df.groupBy(key).agg(last).select(key, "_last.*")


def online_features(keys: DataFrame, views: Sequence[FeatureView], now: Column) -> DataFrame:
    """Latest value per key from several views as of ``now``; a value older than the view's ttl is null."""
    out = keys
    for v in views:
        t = v.table.where(F.col(v.ts) <= now)
        if v.ttl_seconds is not None:
            t = t.where(F.col(v.ts) >= now - F.expr(f"interval {v.ttl_seconds} seconds"))
        order = [v.ts, v.created] if v.created else [v.ts]
        last = latest_per_key(t, v.key, order, list(v.columns))
        out = out.join(last.select(v.key, *[F.col(c).alias(f"{v.name}__{c}") for c in v.columns]), v.key, "left")
    return out


def materialize(view: FeatureView, start: Column, end: Column, path: str) -> DataFrame:
    """Latest row per key inside [start, end], written to the serving table."""
    t = view.table.where(F.col(view.ts).between(start, end))
    order = [view.ts, view.created] if view.created else [view.ts]
    latest_per_key(t, view.key, order, [view.ts, *view.columns]).write.mode("overwrite").parquet(path)
    return view.table.sparkSession.read.parquet(path)


def parity(offline: DataFrame, online: DataFrame, key: str, column: str, tolerance: float = 1e-6) -> DataFrame:
    """Full outer comparison of two serving paths."""
    a, b = F.col("offline"), F.col("online")
    return (
        offline.select(key, F.col(column).alias("offline"))
        .join(online.select(key, F.col(column).alias("online")), key, "full")
        .withColumn("agree", F.coalesce(F.abs(a - b) < tolerance, a.isNull() & b.isNull()))
    )


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join with a side that has one row per key. A hot key of the big side is split by adaptive execution, and only that key:
    the join keeps Spark's own exchanges, so nothing stands in the way."""
    return big.join(small, key, how)


def lookup_with_global_mean(df: DataFrame, train: DataFrame, key: str, target: str, name: str) -> DataFrame:
    """Mean of the target per key learned on ``train``; an unseen key gets the global mean."""
    sums = train.groupBy(key).agg(F.sum(target).alias("_sum"), F.count(target).alias("_n"))
    means = sums.select(key, (F.col("_sum") / F.col("_n")).alias("_mean"))
    overall = sums.agg((F.sum("_sum") / F.sum("_n")).alias("mean"))
    out = attach(lookup_join(df, means, key, "left"), overall, "_g")
    return out.withColumn(name, F.coalesce("_mean", F.col("_g.mean"))).drop("_mean", "_g")


def overlap_audit(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test rows whose key tuple also occurs in train."""
    return test.join(train.select(*keys).distinct(), list(keys), "left_semi")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def order_totals(lines: DataFrame, products: DataFrame, line_product: str, product_key: str, order_key: str,
                 quantity: str, price_cents: Column) -> DataFrame:
    """Integer-cent total per order: quantity times product price."""
    p = products.select(F.col(product_key).alias(line_product), price_cents.alias("_cents"))
    return lookup_join(lines.select(order_key, line_product, quantity), p, line_product).groupBy(order_key).agg(
        F.sum(F.col(quantity).cast("long") * F.col("_cents")).alias("total_cents"), F.count(F.lit(1)).alias("lines"))


def nearest_donors(recipients: DataFrame, donors: DataFrame, key: str, x: str, k: int, carry: Sequence[str] = (),
                   by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` donors nearest in ``x`` per recipient; ties go to the smaller donor key.

    In one dimension they are among the ``k`` donors before and the ``k`` after the recipient in sort
    order. So each donor gets a rank, each recipient the number of donors below it, and an equi-join on
    the 2k wanted ranks finds the candidates: linear work, no pairing of everything with everything.
    Needs numeric keys. Returns (by, key, donor, distance, nth, carried columns of the donor).
    """
    by = list(by)
    # three orderings read this narrow table; what it was derived from is computed once
    narrow = settle(donors.select(*by, key, x, *carry, F.lit(1).alias("_d")).unionByName(
        recipients.select(*by, key, x, *carry, F.lit(0).alias("_d"))), "nearest")
    donors, recipients = narrow.where("_d = 1"), narrow.where("_d = 0")
    d = donors.select(*by, F.col(key).alias("donor"), F.col(x).alias("_dx"), *carry)
    up = row_numbers(d, ["_dx", "donor"], "_rank", by).withColumn("_dir", F.lit("up"))
    down = row_numbers(d, ["_dx", -F.col("donor")], "_rank", by).withColumn("_dir", F.lit("down"))
    r = recipients.select(*by, F.col(key), F.col(x).alias("_x"))
    both = r.withColumn("_d", F.lit(0)).unionByName(
        d.select(*by, F.col("donor").alias(key), F.col("_dx").alias("_x"), F.lit(1).alias("_d")))
    # a recipient sorts before donors of its own value, so the count is of strictly smaller ones
    placed = running_sums(both, ["_x", "_d", key], {"_below": "_d"}, by).where("_d = 0").drop("_d")
    steps = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(F.lit("up").alias("dir"), (F.col("_below") + i).alias("rank")))
    back = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.lit("down").alias("dir"), (F.col("_below") - i).alias("rank")))
    asked = placed.select(*by, key, "_x", F.inline(F.concat(steps, back)).alias("_dir", "_rank")).where("_rank > 0")
    hits = asked.join(up.unionByName(down), [*by, "_dir", "_rank"])
    hits = hits.withColumn("distance", F.abs(F.col("_x") - F.col("_dx")))
    best = Window.partitionBy(*by, key).orderBy("distance", "donor")
    # at most 2k candidates per recipient
    return hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("_dir", "_rank", "_x", "_dx")
