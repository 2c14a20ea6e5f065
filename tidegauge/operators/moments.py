"""Sums of vectors per group in one pass: batches add up their own part, tasks hand over one vector a group."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 4 << 20  # numbers a task holds before it hands them over; it steers memory, never the result


def vector_sums(df: DataFrame, by: dict[str, str], parts: Callable[[pd.DataFrame], Iterable[tuple[tuple, np.ndarray]]], name: str = "sums") -> DataFrame:
    """(by..., ``name`` array<double>): the sum of the vectors that ``parts`` yields, as (key, vector), for the batches of ``df``.

    ``by`` names the key columns and their types. Vectors of one key have one length. What is shuffled is one vector per task and key (more
    where a task holds very many keys), element by element, so that any key is added up by many tasks.
    """
    keys = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        size = 0

        def handed() -> pd.DataFrame:
            return pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, name])

        for b in batches:
            for k, v in parts(b):
                if k in held:
                    held[k] += v
                else:
                    held[k] = np.array(v, np.float64)
                    size += len(v)
                if size > HELD:
                    yield handed()
                    held.clear()
                    size = 0
        if held:
            yield handed()

    partial = df.mapInPandas(run, ", ".join([*[f"`{k}` {t}" for k, t in by.items()], f"`{name}` array<double>"]))
    total = partial.select(*keys, F.posexplode(name).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
    whole = F.array_sort(F.collect_list(F.struct("_i", "_x")))  # as long as the vector
    return total.groupBy(*keys).agg(whole.alias("_w")).select(*keys, F.col("_w._x").alias(name))
