"""How far draws of several chains can be trusted: rank-normalised split R-hat, bulk and tail effective sizes, shortest intervals."""
from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidegauge.operators.moments import vector_sums
from tidegauge.operators.ordering import exact_quantiles, row_numbers, running_sums, same
from tidegauge.session import settle

BLOCK = 512  # draws of a block and lags of a step (even): it sets the memory of a row, never the result
SERIES = ["param", "kind"]
HALF = [*SERIES, "chain", "h"]


@F.pandas_udf(DoubleType())
def normal_score(share: pd.Series) -> pd.Series:
    inv = NormalDist().inv_cdf
    return pd.Series([inv(p) for p in share], dtype="float64")


def split_chains(draws: DataFrame, param: str, chain: str, draw: str, value: str) -> DataFrame:
    """(param, chain, h, p, x): each chain as two halves with positions from 0; the middle draw of an odd chain belongs to neither."""
    d = draws.select(F.col(param).alias("param"), F.col(chain).alias("chain"), F.col(draw).alias("draw"), F.col(value).cast("double").alias("x"))
    d = d.where(F.col("x").isNotNull() & ~F.isnan("x"))
    size = d.groupBy("param", "chain").agg(F.count(F.lit(1)).alias("n"))
    pos = same(row_numbers(d, ["draw", "x"], "_pos", ["param", "chain"]), size, ["param", "chain"]).withColumn("half", F.floor(F.col("n") / 2))
    first, second = F.col("_pos") <= F.col("half"), F.col("_pos") > F.col("n") - F.col("half")
    at = F.when(first, F.col("_pos") - 1).otherwise(F.col("_pos") - 1 - (F.col("n") - F.col("half")))
    return pos.where(first | second).select("param", "chain", F.when(first, 0).otherwise(1).alias("h"), at.alias("p"), "x")


def normal_scores(rows: DataFrame) -> DataFrame:
    """``x`` of each series replaced by the normal score of its mean rank; equal values are counted first."""
    values = rows.groupBy(*SERIES, "x").agg(F.count(F.lit(1)).alias("c"))
    size = values.groupBy(*SERIES).agg(F.sum("c").alias("s"))
    ranked = same(running_sums(values, ["x"], {"upto": "c"}, SERIES), size, SERIES)
    rank = F.col("upto") - (F.col("c") - 1) / 2
    scored = ranked.select(*SERIES, "x", normal_score((rank - 0.375) / (F.col("s") + 0.25)).alias("z"))
    return same(rows, scored, [*SERIES, "x"]).select(*HALF, "p", F.col("z").alias("x"))


def value_blocks(rows: DataFrame, halves: DataFrame, block: int) -> DataFrame:
    """(half, b, n, parts, v): centred values of ``block`` successive draws as one array; ``n`` draws in the half, ``parts`` halves in the series."""
    centred = same(rows, halves.select(*HALF, "n", "m", "parts"), HALF)
    at = F.array_sort(F.collect_list(F.struct("p", (F.col("x") - F.col("m")).alias("v"))))  # ``block`` values at most
    return centred.groupBy(*HALF, "n", "parts", F.floor(F.col("p") / block).cast("int").alias("b")).agg(at.alias("_a")).select(
        *HALF, "b", "n", "parts", F.col("_a.v").alias("v"))


def autocovariances(blocks: DataFrame, first: int, last: int, block: int) -> DataFrame:
    """(param, kind, k, sums): mean over halves of the autocovariance at lags ``k * block`` and on, for k from ``first`` to ``last``.

    A block meets the two blocks that lie k and k + 1 before it, so a row holds three blocks however long the chain.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    left = blocks.withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(last)))).where("b >= k").withColumn("b", F.col("b") - F.col("k"))
    near = blocks.select(*HALF, "b", F.col("v").alias("near"))
    far = blocks.select(*HALF, (F.col("b") + 1).alias("b"), F.col("v").alias("far"))
    met = same(same(left, near, [*HALF, "b"]), far, [*HALF, "b"], "left").select(*SERIES, "k", "n", "parts", "v", "near", "far")
    size = 1 << (3 * block - 1).bit_length()

    def parts(b: pd.DataFrame) -> Iterator[tuple[tuple, np.ndarray]]:
        for row in b.itertuples(index=False):
            past = np.zeros(2 * block)
            if row.far is not None:
                past[:block] = row.far
            past[block:block + len(row.near)] = row.near
            both = np.fft.irfft(np.fft.rfft(row.v, size) * np.fft.rfft(past[::-1], size), size)
            yield (None if pd.isna(row.param) else row.param, row.kind, int(row.k)), both[block - 1:2 * block - 1] / (row.n * row.parts)

    return vector_sums(met, {"param": kinds["param"], "kind": "string", "k": "int"}, parts)


def positive_sequence(acov: DataFrame, state: DataFrame, block: int) -> DataFrame:
    """One step of the initial monotone sequence: pairs of correlations up to the first that is not positive, none above an earlier one."""
    c = same(acov, state, SERIES)
    even = F.sequence(F.lit(0), F.lit(block - 2), F.lit(2))
    rho = lambda i: 1 - (F.col("w") - F.get("sums", i)) / F.col("var_plus")
    whole = F.greatest(F.lit(0), F.least(F.lit(block // 2), F.floor((F.col("least_n") - 2 - F.col("k") * block) / 2))).cast("int")
    c = c.withColumn("pairs", F.slice(F.transform(even, lambda i: rho(i) + rho(i + 1)), F.lit(1), whole))
    stop = F.array_position(F.transform("pairs", lambda x: x <= 0), True)
    c = c.withColumns({"head": F.when(stop > 0, F.slice("pairs", F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(F.col("pairs")),
                       "ends": (stop > 0) | (whole < block // 2)})
    before = Window.partitionBy(*SERIES).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # one row for ``block`` lags
    c = c.withColumns({"over": F.coalesce(F.bool_or("ends").over(before), F.lit(False)), "cap": F.least(F.col("low"), F.min(F.array_min("head")).over(before))})
    start = F.struct(F.coalesce("cap", F.lit(float("inf"))).alias("low"), F.lit(0.0).alias("s"))

    def add(acc: Column, x: Column) -> Column:
        low = F.least(acc["low"], x)
        return F.struct(low.alias("low"), (acc["s"] + low).alias("s"))

    c = c.where("not over").withColumn("run", F.aggregate("head", start, add))
    return c.groupBy(*SERIES).agg(F.sum("run.s").alias("_s"), F.min("run.low").alias("_low"), F.bool_or("ends").alias("_ends"))


def effective_sizes(rows: DataFrame, halves: DataFrame, series: DataFrame, block: int) -> DataFrame:
    """(param, kind, ess). Lags are taken in steps that double, for the series whose sequence still runs."""
    state = series.where("w > 0 and least_n >= 4").select(*SERIES, "w", "var_plus", "least_n", F.lit(None).cast("double").alias("low"), F.lit(0.0).alias("total"))
    state = settle(state, "sequence")
    blocks = settle(value_blocks(rows, halves, block), "blocks")
    done, first, last = None, 0, 0
    while not state.isEmpty():
        acov = settle(autocovariances(same(blocks, state.select(*SERIES), SERIES), first, last, block), "autocovariance")
        step = settle(same(state, positive_sequence(acov, state, block), SERIES), "sequence")
        step = step.withColumns({"total": F.col("total") + F.col("_s"), "low": F.col("_low")})
        ended = step.where("_ends").select(*SERIES, "total")
        done = ended if done is None else done.unionByName(ended)
        state = step.where("not _ends").select(*state.columns)
        first, last = last + 1, 2 * last + 1
    s = F.col("s")
    if done is None:
        out = series.withColumn("total", F.lit(None).cast("double"))
    else:
        out = same(series, done, SERIES, "left")
    tau = F.greatest(2 * F.col("total") - 1, 1 / F.log10(s))
    return out.select(*SERIES, F.when(F.col("least_n") < 4, None).when(F.col("w") == 0, s.cast("double")).otherwise(s / tau).alias("ess"))


def shortest_interval(draws: DataFrame, param: str, chain: str, draw: str, value: str, mass: float = 0.94) -> DataFrame:
    """(param, hdi_low, hdi_high): the narrowest interval from one draw to another with ``mass`` of the draws between them (ties to the lowest)."""
    d = draws.select(F.col(param).alias("param"), F.col(chain).alias("c"), F.col(draw).alias("d"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    size = d.groupBy("param").agg(F.floor(F.count(F.lit(1)) * mass).alias("span"))
    at = settle(same(row_numbers(d, ["x", "c", "d"], "r", ["param"]), size, ["param"]).select("param", "r", "x", "span"), "ranks")
    upper = at.select("param", (F.col("r") - F.col("span")).alias("r"), F.col("x").alias("top"))
    best = same(at, upper, ["param", "r"]).groupBy("param").agg(F.min(F.struct((F.col("top") - F.col("x")).alias("wide"), "x", "top")).alias("b"))
    return best.select("param", F.col("b.x").alias("hdi_low"), F.col("b.top").alias("hdi_high"))


def convergence(draws: DataFrame, param: str, chain: str, draw: str, value: str, mass: float = 0.94, block: int = BLOCK) -> DataFrame:
    """(param, draws, mean, sd, hdi_low, hdi_high, mcse_mean, ess_bulk, ess_tail, rhat) per parameter.

    R-hat is the larger of those of normal scores and of scores of distances from the median, over chains in halves. Effective sizes sum the
    initial monotone sequence of autocorrelations: of scores (bulk), of the values (for the error of the mean), and the smaller of those of
    the indicators below the 5 % and the 95 % quantile (tail). A chain counts with its own length; lags end with the shortest half. Null and NaN
    draws are left out. Halves of fewer than four draws give null sizes, a constant parameter null R-hat and its number of draws as size.
    """
    if block < 2 or block % 2:
        raise ValueError("block must be even")
    split = settle(split_chains(draws, param, chain, draw, value), "halves")
    q = exact_quantiles(split, "x", [0.05, 0.5, 0.95], ["param"]).select("param", "q")
    wide = same(split, q, ["param"])
    kinds = {"mean": F.col("x"), "low": (F.col("x") <= F.col("q")[0]).cast("double"), "high": (F.col("x") <= F.col("q")[2]).cast("double"),
             "bulk": F.col("x"), "folded": F.abs(F.col("x") - F.col("q")[1])}
    form = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in kinds.items()])
    rows = settle(wide.select("param", "chain", "h", "p", F.inline(form)).select(*HALF, "p", F.col("v").alias("x")), "series")
    ranked = F.col("kind").isin("bulk", "folded")
    rows = settle(rows.where(~ranked).unionByName(normal_scores(rows.where(ranked))), "scores")
    halves = rows.groupBy(*HALF).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"),
                                     F.when(F.min("x") == F.max("x"), 0.0).otherwise(F.var_samp("x")).alias("v"))
    series = halves.groupBy(*SERIES).agg(F.sum("n").alias("s"), F.avg("n").alias("len"), F.min("n").alias("least_n"), F.avg("v").alias("w"),
                                         F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"), F.count(F.lit(1)).alias("parts"))
    series = settle(series.withColumn("var_plus", (F.col("len") - 1) / F.col("len") * F.col("w") + F.col("between")), "spread")
    halves = same(halves, series.select(*SERIES, "parts"), SERIES)
    ess = effective_sizes(rows.where("kind <> 'folded'"), halves.where("kind <> 'folded'"), series.where("kind <> 'folded'"), block)
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    sizes = ess.groupBy("param").agg(of("bulk", "ess").alias("ess_bulk"), of("mean", "ess").alias("_ess_mean"), F.least(of("low", "ess"), of("high", "ess")).alias("ess_tail"))
    ratio = series.where(F.col("kind").isin("bulk", "folded")).groupBy("param").agg(F.max(F.sqrt(F.try_divide("var_plus", "w"))).alias("rhat"))
    x = F.col(value).cast("double")
    plain = draws.select(F.col(param).alias("param"), x.alias("x")).where("x is not null and not isnan(x)").groupBy("param").agg(
        F.count(F.lit(1)).alias("draws"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    out = same(same(same(plain, shortest_interval(draws, param, chain, draw, value, mass), ["param"], "left"), sizes, ["param"], "left"), ratio, ["param"], "left")
    return out.select(F.col("param").alias(param), "draws", "mean", "sd", "hdi_low", "hdi_high", (F.col("sd") / F.sqrt("_ess_mean")).alias("mcse_mean"), "ess_bulk", "ess_tail", "rhat")
