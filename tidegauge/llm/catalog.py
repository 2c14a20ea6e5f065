"""Queries of this subpackage, registered apart from those of the library."""
from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def load() -> tuple[dict, dict]:
    """Import every query module of the subpackage (``op*``); returns (queries, SQL twins)."""
    package = importlib.import_module(__package__)
    for m in sorted(pkgutil.iter_modules(package.__path__), key=lambda m: m.name):
        if m.name.startswith("op"):
            importlib.import_module(f"{__package__}.{m.name}")
    return dict(QUERIES), dict(SQL)
