"""Easy ensemble: AdaBoost of decision stumps in balanced bags, all bags boosted by the same scans."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import sigmoid
from tidegauge.operators.aggregates import long_form
from tidegauge.operators.moments import vector_sums
from tidegauge.operators.ordering import exact_quantiles
from tidegauge.operators.splits import balanced_bags
from tidegauge.operators.stats import bin_index
from tidegauge.session import settle


@dataclass
class Boosted:
    """Stumps of all bags as votes: ``votes[bag, feature, bin]`` is what a value adds for class 1, ``total[bag]`` all that the bag's stumps can add.

    A stump asks one feature, so a bag's vote is a sum over features of one lookup each, however many rounds it was boosted.
    """

    features: list[str]
    edges: list[list[float]]
    votes: np.ndarray
    total: np.ndarray


def best_stump(weight: np.ndarray) -> tuple[int, int, int, int, float] | None:
    """(feature, last bin of the left side, class left, class right, weighted error) of the least Gini impurity from weights (feature, bin, class).

    Ties go to the smaller feature, then the smaller bin; a side's tied classes to 0. None where no cut leaves weight on both sides.
    """
    left = weight.cumsum(1)[:, :-1]
    right = weight.sum(1, keepdims=True) - left
    nl, nr = left.sum(2), right.sum(2)
    whole = weight[0].sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        impurity = 2 * (left.prod(2) / nl + right.prod(2) / nr)
    impurity = np.where((nl > 1e-12 * whole) & (nr > 1e-12 * whole), impurity, np.inf)
    if not impurity.size or not np.isfinite(impurity.min()):
        return None
    f, cut = np.unravel_index(int((impurity <= impurity.min() + 1e-12 * whole).argmax()), impurity.shape)  # the first, near ties included
    sides = left[f, cut], right[f, cut]
    return int(f), int(cut), int(sides[0][1] > sides[0][0]), int(sides[1][1] > sides[1][0]), float(sum(s.min() for s in sides) / whole)


def row_weights(votes: np.ndarray, total: float, codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """AdaBoost weights after the stumps behind ``votes``: each stump multiplied those of its wrong rows by exp of its vote."""
    for_one = votes[np.arange(votes.shape[0])[:, None], codes.T].sum(0)
    return np.exp(np.where(y == 1, total - for_one, for_one))


def codes_of(features: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    """Bin number of each feature; null and NaN fall into the first bin."""
    known = [F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features]
    return F.array(*[F.coalesce(bin_index(x, F.array(*[F.lit(v) for v in e]).cast("array<double>")), F.lit(0)) for x, e in zip(known, edges)])


def fit_boosted(train: DataFrame, key: str, features: Sequence[str], label: str, bags: int = 25, rounds: int = 50, bins: int = 32, seed: int = 42) -> Boosted:
    """``bags`` balanced undersamples, each boosted for ``rounds`` rounds (discrete AdaBoost for a 0/1 label).

    Cuts are exact quantiles of the training rows, ``bins`` - 1 a feature at most. Rows that share bag, bins and label have one weight at every round: they
    are counted once, and the counts written. A round is one scan for all bags together: weights follow from the votes so far, so no weight
    is stored, and what comes back are (feature, bin, class) sums of each bag. A bag ends early when a stump makes no error (its vote is then 1), is no better
    than chance (it is left out), or no cut is left. Rows with a null label take no part.
    """
    features = list(features)
    rows = train.select(key, F.col(label).cast("int").alias("y"), *features).where("y is not null")
    cuts = exact_quantiles(long_form(rows, features, [], "feature", "x"), "x", [i / bins for i in range(1, bins)], ["feature"])
    held = {r["feature"]: sorted({v for v in r["q"] if v is not None and v == v}) for r in cuts.collect()}  # features x bins
    edges = [held.get(f, []) for f in features]
    members = balanced_bags(rows, key, "y", bags, seed).select("bag", "y", codes_of(features, edges).alias("codes"))
    counted = settle(members.groupBy("bag", "y", "codes").agg(F.count(F.lit(1)).alias("n")), "bag-cells")
    width = max(map(len, edges), default=0) + 1
    votes, total, open_bags = np.zeros((bags, len(features), width)), np.zeros(bags), np.ones(bags, bool)
    spark = train.sparkSession
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((votes.copy(), total.copy(), open_bags.copy()))

        def sums(b: pd.DataFrame, now=now):
            v, t, going = now.value
            for bag, g in b.groupby("bag", sort=False):
                if going[bag]:
                    codes, y = np.stack(g["codes"].to_numpy()), g["y"].to_numpy()
                    w = row_weights(v[bag], t[bag], codes, y) * g["n"].to_numpy()
                    out = np.zeros((len(features), width, 2))
                    for f in range(len(features)):
                        np.add.at(out[f], (codes[:, f], y), w)
                    yield (int(bag),), out.ravel()

        for r in vector_sums(counted, {"bag": "int"}, sums).collect():
            bag, stump = r["bag"], best_stump(np.array(r["sums"]).reshape(len(features), width, 2))
            if stump is None or stump[4] >= 0.5:
                open_bags[bag] = False
                continue
            f, cut, left, right, error = stump
            alpha = float(np.log((1 - error) / error)) if error > 0 else 1.0
            open_bags[bag] = error > 0
            votes[bag, f, :cut + 1] += alpha * left
            votes[bag, f, cut + 1:] += alpha * right
            total[bag] += alpha
        now.destroy()
        if not open_bags.any():
            break
    return Boosted(features, edges, votes, total)


def boosted_probability(df: DataFrame, model: Boosted, name: str = "prob") -> DataFrame:
    """``df`` with the mean over bags of sigmoid(2 m), m the bag's weighted mean vote in [-1, 1]. Plain column lookups; a bag without stumps says 0.5."""
    codes, bags = codes_of(model.features, model.edges), len(model.total)
    tables = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in model.votes[b, f]]) for f in range(len(model.features))]) for b in range(bags)])
    per_bag = F.zip_with(tables, F.array(*[F.lit(float(t)) for t in model.total]), lambda table, t: F.when(t > 0, sigmoid(
        2 * (2 * F.aggregate(F.zip_with(table, F.col("_codes"), lambda row, c: F.get(row, c)), F.lit(0.0), lambda s, x: s + x) / t - 1))).otherwise(0.5))
    return df.withColumn("_codes", codes).withColumn(name, F.aggregate(per_bag, F.lit(0.0), lambda s, x: s + x) / bags).drop("_codes")
