"""Level-wise contribution against the cube."""
import random

from pyspark.sql import functions as F

from tidegauge.operators import aggregates as A


def test_cells_are_those_of_the_cube_above_the_support(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([1, 1, 1, 2, r.randrange(99)]), r.choice(["x", "y"]), r.random() < 0.4, r.randrange(50)) for _ in range(800)]
    d = spark.createDataFrame(rows, "p string, q int, r string, late boolean, m long").withColumn("grouping", F.lit("own"))
    dims = ["p", "q", "r"]
    cube = d.cube(*dims).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("late"), F.col("m")).otherwise(0)).alias("t"), F.sum(F.when(F.col("late"), 0).otherwise(F.col("m"))).alias("c"))
    for support in (0.05, 0.3, 0.0001):
        got = A.frequent_contribution(d, dims, F.col("m"), F.col("late"), support).select(*dims, "grouping", "n", "test", "control").collect()
        want = cube.where(F.col("n") >= 800 * support).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    assert A.frequent_contribution(d.where("m > 99"), dims, F.col("m"), F.col("late")).collect() == []
