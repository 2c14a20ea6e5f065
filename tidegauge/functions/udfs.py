"""User-defined functions: a prediction function for SQL, table scoring, per-row policies, reusable aggregates."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def register_linear(spark: SparkSession, name: str, intercept: float, coefficients: Sequence[float]) -> None:
    """Register ``name(f1, f2, ...)`` for SQL as an Arrow-batched function."""
    b, a = list(coefficients), float(intercept)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        out = pd.Series(a, index=cols[0].index, dtype="float64")
        for w, c in zip(b, cols):
            out = out + w * c.astype("float64")
        return out

    spark.udf.register(name, score)


def score_query(spark: SparkSession, model: PipelineModel, sql: str, label: str) -> DataFrame:
    """Table-valued scoring: every row of a query with its prediction (no Python on the way)."""
    df = spark.sql(sql)
    return model.transform(df).select(*df.columns, f"predicted_{label}")


def register_table_scorer(spark: SparkSession, name: str, intercept: float, coefficients: Mapping[str, float], label: str) -> None:
    """Register the table function ``name(TABLE(query))`` for SQL: the query's columns and ``predicted_<label>`` of a linear model.

    The output schema follows from the query (``analyze``); a query that lacks a feature column, or has the predicted one, is refused before it runs. Rows
    are scored where they lie. A null feature gives a null prediction. Functions with a schema of their own take row after row:
    ``score_query`` is the faster way where the query need not stand inside other SQL.
    """
    weights, start, out = dict(coefficients), float(intercept), f"predicted_{label}"

    class Score:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes TABLE(query)")
            fields = rows.dataType.fieldNames()
            if lacking := [c for c in weights if c not in fields]:
                raise ValueError(f"{name}: the query has no column {', '.join(lacking)}")
            if out in fields:
                raise ValueError(f"{name}: the query already has a column {out}")
            return AnalyzeResult(schema=StructType([*rows.dataType.fields, StructField(out, DoubleType())]))

        def eval(self, row: Row):
            values = [row[c] for c in weights]
            yield *row, None if None in values else start + sum(w * float(v) for w, v in zip(weights.values(), values))

    spark.udtf.register(name, F.udtf(Score))


def apply_policies(df: DataFrame, which: str, policies: Mapping[str, Callable[[pd.DataFrame], pd.Series]], name: str = "action") -> DataFrame:
    """Let a pluggable policy choose an action for each observation row.

    A policy maps a frame of observations to a series of actions. Rows are handed over in Arrow batches
    where they lie, so no group has to be gathered, however many rows it holds.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{name} string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b[name] = None
            for key, part in b.groupby(which, sort=False):
                if key in policies:
                    b.loc[part.index, name] = policies[key](part).astype(str).to_numpy()
            yield b

    return df.mapInPandas(run, schema)


def psi_column(bin_of: Column, is_current: Column, is_reference: Column, bins: int = 10, eps: float = 1e-4) -> Column:
    """Stability index as an aggregate for any ``groupBy``: built from conditional counts."""
    cn, rn = F.count_if(is_current), F.count_if(is_reference)
    out = F.lit(0.0)
    for i in range(bins):
        p = F.greatest(F.try_divide(F.count_if(is_current & (bin_of == i)), cn), F.lit(eps))
        q = F.greatest(F.try_divide(F.count_if(is_reference & (bin_of == i)), rn), F.lit(eps))
        out = out + (p - q) * F.log(p / q)
    return out


def macro_f1_column(label: Column, pred: Column, classes: Sequence) -> Column:
    """Macro F1 over given classes as an aggregate for any ``groupBy``."""
    out = F.lit(0.0)
    for c in classes:
        tp, both = F.count_if((label == c) & (pred == c)), F.count_if(label == c) + F.count_if(pred == c)
        out = out + F.coalesce(F.try_divide(2.0 * tp, both.cast("double")), F.lit(0.0))
    return out / len(classes)
