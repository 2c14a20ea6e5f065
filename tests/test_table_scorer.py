"""The SQL table function over any query."""
import pytest

from tidegauge.functions.udfs import register_table_scorer


def test_schema_follows_the_query(spark):
    register_table_scorer(spark, "tg_test_score", 1.0, {"a": 2.0, "b": -1.0}, "y")
    spark.createDataFrame([(1, 2.0, "k"), (3, None, "n")], "a long, b double, name string").createOrReplaceTempView("tg_test_rows")
    got = spark.sql("SELECT * FROM tg_test_score(TABLE(SELECT name, b, a FROM tg_test_rows)) ORDER BY a")
    assert got.columns == ["name", "b", "a", "predicted_y"] and dict(got.dtypes)["a"] == "bigint"
    assert [tuple(r) for r in got.collect()] == [("k", 2.0, 1, 1.0), ("n", None, 3, None)]
    assert spark.sql("SELECT * FROM tg_test_score(TABLE(SELECT a, b FROM tg_test_rows WHERE a > 9))").collect() == []
    for bad in ("SELECT a FROM tg_test_rows", "SELECT a, b, 1 AS predicted_y FROM tg_test_rows"):
        with pytest.raises(Exception, match="tg_test_score"):
            spark.sql(f"SELECT * FROM tg_test_score(TABLE({bad}))").collect()
