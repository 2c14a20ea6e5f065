"""Split orderings against plain windows, on data where one key holds most rows."""
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.operators import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(6000):
        key = None if i % 97 == 0 else ("hot" if i % 3 else f"k{i % 40}")
        val = None if i % 50 == 0 else (7.0 if i % 4 == 0 else round(rnd.uniform(-50, 50), 1))
        rows.append((i, key, val))
    return spark.createDataFrame(rows, "id long, key string, v double").repartition(5)


@pytest.mark.parametrize("n", [8, 48, 200])
def test_buckets_follow_the_sort_order(skewed, n):
    b = O.order_buckets(skewed, ["key", "v", "id"], n=n).orderBy("key", "v", "id").select("_b").collect()
    got = [r[0] for r in b]
    assert got == sorted(got)
    assert len(set(got)) > n // 2
    assert max(got.count(x) for x in set(got)) < 6000 / n * 4  # the hot key is spread


@pytest.mark.parametrize("by", [[], ["key"]])
def test_running_sums_equal_a_window(skewed, by):
    d = skewed.withColumn("x", F.coalesce("v", F.lit(0.0)))
    w = Window.partitionBy(*by).orderBy(F.desc("x"), "id").rowsBetween(Window.unboundedPreceding, 0)
    r = O.running_sums(d, [-F.col("x"), "id"], {"s": "x", "n": F.lit(1).cast("long")}, by)
    bad = r.withColumn("s2", F.sum("x").over(w)).withColumn("n2", F.count(F.lit(1)).over(w)).where("abs(s - s2) > 1e-6 or n <> n2")
    assert r.count() == 6000 and bad.count() == 0


def test_carry_last_equals_a_window(skewed):
    w = Window.partitionBy("key").orderBy("id")
    r = O.carry_last(skewed, ["id"], {"v": "last_v"}, ["key"])
    assert r.withColumn("x", F.last("v", True).over(w)).where("not (x <=> last_v)").count() == 0 and r.count() == 6000


def test_exact_quantiles(skewed):
    got = {r["key"]: r for r in O.exact_quantiles(skewed, "v", [0, 0.1, 0.5, 0.9, 1], ["key"]).collect()}
    data = {}
    for r in skewed.where("v is not null").collect():
        data.setdefault(r["key"], []).append(r["v"])
    assert set(got) == set(data)
    for k, vals in data.items():
        vals.sort()
        for p, q in zip([0, 0.1, 0.5, 0.9, 1], got[k]["q"]):
            h = p * (len(vals) - 1)
            lo = vals[math.floor(h)]
            assert q == pytest.approx(lo + (vals[math.ceil(h)] - lo) * (h - math.floor(h)), abs=1e-9)
        assert got[k]["n"] == len(vals)


def test_timestamp_and_date_keys(spark):
    d = spark.range(500).select("id", (F.lit("2024-03-31").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * 7)).alias("t"))
    d = d.withColumns({"z": F.col("t").cast("timestamp"), "d": F.to_date("t")})
    for key in ("t", "z", "d"):
        b = [r[0] for r in O.order_buckets(d, [key, "id"], n=20).orderBy(key, "id").select("_b").collect()]
        assert b == sorted(b) and len(set(b)) > 10
