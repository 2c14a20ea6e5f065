"""Tests and estimators. Each reduces the table by partial aggregation to a row (or a small matrix) per group."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.digests import LANES, counted, counts, first_numbers
from tidegauge.functions.hashing import digest, key_prefix, poisson1_edges, poisson1_of, standard_normal, unit_hash
from tidegauge.functions.tails import chi2_p, kolmogorov_p, t_critical, t_two_sided_p
from tidegauge.operators.aggregates import long_form
from tidegauge.operators.ordering import attach, exact_quantiles, row_numbers, running_sums, same
from tidegauge.session import settle


def two_group_test(df: DataFrame, value: str, group: str, a, b, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Welch t, its degrees of freedom and p, and Cohen's d with pooled variance."""
    w = weight if weight is not None else F.lit(1)
    cols = []
    for tag, level in (("a", a), ("b", b)):
        hit = F.when(F.col(group) == F.lit(level), w)
        cols += [F.sum(hit).alias(f"n{tag}"), F.sum(hit * F.col(value)).alias(f"s{tag}"), F.sum(hit * F.col(value) * F.col(value)).alias(f"q{tag}")]
    m = df.where(F.col(value).isNotNull()).groupBy(*by).agg(*cols)
    for t in "ab":
        n, s, q = F.col(f"n{t}"), F.col(f"s{t}"), F.col(f"q{t}")
        m = m.withColumn(f"m{t}", F.try_divide(s, n)).withColumn(f"v{t}", F.try_divide(q - F.try_divide(s * s, n), n - 1))
    # a group of fewer than two rows gives null, not an error
    over = F.try_divide
    ea, eb = over(F.col("va"), F.col("na")), over(F.col("vb"), F.col("nb"))
    pooled = over((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), F.col("na") + F.col("nb") - 2)
    m = m.withColumns({
        "t": over(F.col("ma") - F.col("mb"), F.sqrt(ea + eb)),
        "df": over(F.pow(ea + eb, F.lit(2)), over(F.pow(ea, F.lit(2)), F.col("na") - 1) + over(F.pow(eb, F.lit(2)), F.col("nb") - 1)),
        "cohens_d": over(F.col("ma") - F.col("mb"), F.sqrt(pooled))})
    return m.withColumn("p", t_two_sided_p(F.col("t"), F.col("df"))).select(
        *by, "na", "nb", F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"), "t", "df", "p", "cohens_d")


def chi_square(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Independence test and Cramer's V from the counted cells; Yates correction only at one degree of freedom."""
    cells = df.groupBy(rows, cols).agg(F.count(F.lit(1)).alias("o"))
    r = cells.groupBy(rows).agg(F.sum("o").alias("r"))
    c = cells.groupBy(cols).agg(F.sum("o").alias("c"))
    size = attach(r.agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("nr")), c.agg(F.count(F.lit(1)).alias("nc"), F.min("c").alias("minc")), "_c")
    size = attach(size, r.agg(F.min("r").alias("minr")), "_r")
    size = size.select("n", "nr", "_c.nc", ((F.col("nr") - 1) * (F.col("_c.nc") - 1)).alias("dof"), (F.col("_r.minr") * F.col("_c.minc") / F.col("n")).alias("min_expected"))
    # an absent cell contributes its expectation, so the sum over present cells is completed by n
    full = attach(same(same(cells, r, [rows]), c, [cols]), size)
    e = F.col("r") * F.col("c") / F.col("_s.n")
    gap = F.abs(F.col("o") - e)
    part = F.when(F.col("_s.dof") == 1, F.pow(F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0)), 2)).otherwise(F.pow(gap, 2)) / e
    stat = full.agg(F.sum(part).alias("present"), F.sum(e).alias("seen"))
    out = attach(size, stat).withColumn("chi2", F.col("_s.present") + (F.col("n") - F.col("_s.seen"))).drop("_s")
    v = F.sqrt(F.col("chi2") / (F.col("n") * F.least(F.col("nr") - 1, F.col("nc") - 1)))
    return out.withColumn("cramers_v", v).withColumn("p", chi2_p(F.col("chi2"), F.col("dof")))


def paired_test(df: DataFrame, a: Column, b: Column, by: Sequence[str] = ()) -> DataFrame:
    """Paired t test of two score columns with wins and ties."""
    d = df.select(*by, (a - b).alias("d")).groupBy(*by).agg(
        F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"),
        F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"))
    d = d.withColumn("t", F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n")))
    return d.withColumn("p", t_two_sided_p(F.col("t"), (F.col("n") - 1).cast("double")))


def bin_index(x: Column, inner_edges: Column) -> Column:
    """Number of inner edges at or below x: bins closed on the left, open ends."""
    return F.size(F.filter(inner_edges, lambda e: e <= x))


def psi(reference: DataFrame, current: DataFrame, value: str, stream: Sequence[str], window: Sequence[str],
        bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index of every (stream, window) against the stream's reference.

    Edges are the reference's exact quantiles with open ends; shares are clipped after division. Bin
    counts are conditional sums, so an empty bin needs no grid.
    """
    stream, window = list(stream), list(window)
    probs = [i / bins for i in range(1, bins)]
    edges = settle(exact_quantiles(reference, value, probs, stream, "_edges").select(*stream, "_edges"), "edges")
    count = lambda d, keys: _binned(d, edges, value, stream).groupBy(*keys).agg(
        F.array(*[F.count_if(F.col("_bin") == i) for i in range(bins)]).alias("c"), F.count(F.lit(1)).alias("n"))
    ref = count(reference, stream).withColumnsRenamed({"c": "rc", "n": "rn"})
    cur = count(current, [*stream, *window])
    both = same(cur, ref, stream) if stream else attach(cur, ref, "_ref").select("*", "_ref.*").drop("_ref")
    share = lambda c, n: F.transform(c, lambda x: F.greatest(x / n, F.lit(eps)))
    terms = F.zip_with(share(F.col("c"), F.col("n")), share(F.col("rc"), F.col("rn")), lambda p, q: (p - q) * F.log(p / q))
    return both.select(*stream, *window, "n", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("psi"))


def _binned(df: DataFrame, edges: DataFrame, value: str, stream: Sequence[str]) -> DataFrame:
    d = df.select(*df.columns).where(F.col(value).isNotNull())
    d = same(d, edges, stream) if stream else attach(d, edges, "_e").withColumn("_edges", F.col("_e._edges")).drop("_e")
    return d.withColumn("_bin", bin_index(F.col(value), F.col("_edges")))


def ks(reference: DataFrame, current: DataFrame, value: str, stream: Sequence[str], window: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D and asymptotic p of every (stream, window) against the stream's reference.

    Rows are counted per distinct value first. The largest gap lies at, or just before, a value of the
    current sample, so the reference's cumulative count is needed only there: it is computed once per
    stream and serves all windows.
    """
    stream, window = list(stream), list(window)
    r = reference.select(*stream, F.col(value).alias("_x"), F.lit(True).alias("_ref"), *[F.lit(None).alias(f"_w{i}") for i, _ in enumerate(window)])
    c = current.select(*stream, F.col(value).alias("_x"), F.lit(False).alias("_ref"), *[F.col(w).alias(f"_w{i}") for i, w in enumerate(window)])
    ws = [f"_w{i}" for i in range(len(window))]
    counts = r.unionByName(c).where(F.col("_x").isNotNull()).groupBy(*stream, "_x", "_ref", *ws).agg(F.count(F.lit(1)).alias("_c"))
    per_value = counts.groupBy(*stream, "_x").agg(
        F.sum(F.when(F.col("_ref"), F.col("_c")).otherwise(0)).alias("_rc"),
        F.collect_list(F.when(~F.col("_ref"), F.struct(*ws, "_c"))).alias("_cur"))  # one entry per window
    per_value = settle(per_value, "distinct-values")
    cum = running_sums(per_value, ["_x"], {"_rcum": "_rc"}, stream)
    n_ref = per_value.groupBy(*stream).agg(F.sum("_rc").alias("_n"))
    cur = settle(cum.select(*stream, "_x", "_rcum", "_rc", F.inline("_cur")), "reference-counts")
    cur = running_sums(cur, ["_x"], {"_ccum": "_c"}, [*stream, *ws])
    m = cur.groupBy(*stream, *ws).agg(F.sum("_c").alias("_m"))
    j = same(cur, m, [*stream, *ws]) if stream or ws else attach(cur, m, "_mm").withColumn("_m", F.col("_mm._m"))
    j = same(j, n_ref, stream) if stream else attach(j, n_ref, "_nn").withColumn("_n", F.col("_nn._n"))
    at = F.abs(F.col("_ccum") / F.col("_m") - F.col("_rcum") / F.col("_n"))
    before = F.abs((F.col("_ccum") - F.col("_c")) / F.col("_m") - (F.col("_rcum") - F.col("_rc")) / F.col("_n"))
    d = j.groupBy(*stream, *ws).agg(F.max(F.greatest(at, before)).alias("d"), F.max("_m").alias("n"), F.max("_n").alias("n_ref"))
    d = d.withColumnsRenamed({f"_w{i}": w for i, w in enumerate(window)})
    return d.withColumn("p", kolmogorov_p(F.col("d"), F.col("n").cast("double"), F.col("n_ref").cast("double")))


def cross_products(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Sums of products of all column pairs, one row per group: the only pass over the data a solve needs."""
    w = weight if weight is not None else F.lit(1.0)
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    return df.groupBy(*by).agg(*[F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"m_{i}_{j}") for i, j in pairs])


def _matrices(pdf: pd.DataFrame, k: int) -> np.ndarray:
    out = np.zeros((len(pdf), k, k))
    for i in range(k):
        for j in range(i, k):
            out[:, i, j] = out[:, j, i] = pdf[f"m_{i}_{j}"].to_numpy(dtype=float)
    return out


def solve_rows(moments: DataFrame, k: int, by: Sequence[str], schema: str, fn) -> DataFrame:
    """Small dense maths on each moment row: ``fn(matrix) -> list of result tuples``."""
    by = list(by)

    def run(batches):
        for pdf in batches:
            rows = []
            for keys, mat in zip(pdf[by].itertuples(index=False, name=None) if by else [()] * len(pdf), _matrices(pdf, k)):
                rows += [(*keys, *r) for r in fn(mat)]
            names = [c.strip().split(" ")[0] for c in schema.split(",")]
            yield pd.DataFrame(rows, columns=names)

    return moments.mapInPandas(run, schema)


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation factors without an intercept (uncentred R squared): diagonal of the inverse
    moment matrix times the column's sum of squares."""
    names = list(columns)

    def fn(m):
        scale = np.sqrt(np.diag(m))
        scaled = m / np.outer(scale, scale)  # unit diagonal, so the inverse's diagonal is the factor itself
        try:
            factors = np.diag(np.linalg.inv(scaled))
        except np.linalg.LinAlgError:
            factors = np.full(len(names), np.inf)
        # an exactly dependent column has no finite factor; rounding may show it as negative
        return [(c, float(v) if v > 0 else float("inf")) for c, v in zip(names, factors)]

    return solve_rows(cross_products(df, names), len(names), [], "feature string, vif double", fn)


def design_rank(df: DataFrame, columns: Sequence[Column], name: str) -> DataFrame:
    """Rank and width of a design matrix."""
    d = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    cols = d.columns
    fn = lambda m: [(name, len(cols), int(np.linalg.matrix_rank(m, hermitian=True)))]
    return solve_rows(cross_products(d, cols), len(cols), [], "design string, columns int, rank int", fn)


def condition_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ratio of the largest to the smallest singular value of the standardised design."""
    z = standardise(df, columns)
    names = [f"{c}_z" for c in columns]
    fn = lambda m: [(float(np.sqrt(np.linalg.eigvalsh(m)[-1] / max(np.linalg.eigvalsh(m)[0], 1e-300))),)]
    return solve_rows(cross_products(z, names), len(names), [], "condition double", fn)


def standardise(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population sd, both learned on ``fit``."""
    src = fit if fit is not None else df
    s = src.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return attach(df, s, "_fit").withColumns({
        f"{c}{suffix}": F.when(F.col(f"_fit.{c}_s") > 0, (F.col(c) - F.col(f"_fit.{c}_m")) / F.col(f"_fit.{c}_s")).otherwise(0.0) for c in columns}).drop("_fit")


def single_r2(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.regr_r2(F.col(target), F.col(f)).alias(f) for f in features])
    return one.unpivot([], list(features), "feature", "r2").orderBy(F.desc("r2"))


def simple_ols(df: DataFrame, x: str, y: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Slope, intercept, standard error and t interval of a one-feature regression."""
    X, Y = F.col(x), F.col(y)
    m = df.groupBy(*by).agg(
        F.regr_count(Y, X).alias("n"), F.regr_slope(Y, X).alias("slope"), F.regr_intercept(Y, X).alias("intercept"),
        F.regr_sxx(Y, X).alias("sxx"), F.regr_syy(Y, X).alias("syy"), F.regr_sxy(Y, X).alias("sxy"))
    dof = (F.col("n") - 2).cast("double")
    m = m.withColumn("sigma", F.sqrt(F.try_divide(F.col("syy") - F.col("slope") * F.col("sxy"), dof)))
    m = m.withColumn("stderr", F.try_divide(F.col("sigma"), F.sqrt("sxx")))
    m = m.withColumn("_t", t_critical(dof, level))
    return m.select(*by, "n", "slope", "intercept", "stderr", "sigma", (F.col("slope") - F.col("_t") * F.col("stderr")).alias("low"),
                    (F.col("slope") + F.col("_t") * F.col("stderr")).alias("high"))


def ar1(df: DataFrame, series: str, t: str, y: str, level: float = 0.95) -> DataFrame:
    lagged = df.withColumn("_prev", F.lag(y).over(Window.partitionBy(series).orderBy(t))).where(F.col("_prev").isNotNull())
    return simple_ols(lagged, "_prev", y, [series], level)


def anova_f(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """F score of every feature, from one (label, feature) aggregation around the feature's mean."""
    long = long_form(df, features, [label], "feature", "x")
    g = long.groupBy("feature", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    # one row per (feature, label)
    t = g.groupBy("feature").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("centre"),
                                 F.sum(F.col("n") * F.col("v")).alias("ssw"))
    ssb = g.join(t, "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("centre"), 2)).alias("ssb"))
    return t.join(ssb, "feature").select("feature", ((F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("total") - F.col("k")))).alias("f"))


def k_best(scores: DataFrame, k: int, score: str = "f") -> DataFrame:
    return scores.orderBy(F.desc(score), "feature").limit(k)


def mutual_information(df: DataFrame, label: str, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Plug-in mutual information with exact decile bins (a binned estimate, not the nearest-neighbour one)."""
    long = long_form(df, features, [label], "feature", "x")
    edges = exact_quantiles(long, "x", [i / bins for i in range(1, bins)], ["feature"], "_edges").select("feature", "_edges")
    # one row per feature named by the caller
    cells = long.join(F.broadcast(edges), "feature").groupBy("feature", label, bin_index(F.col("x"), F.col("_edges")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    wf, wl, wb = Window.partitionBy("feature"), Window.partitionBy("feature", label), Window.partitionBy("feature", "b")
    p = cells.select("feature", "n", F.sum("n").over(wf).alias("total"), F.sum("n").over(wl).alias("nl"), F.sum("n").over(wb).alias("nb"))
    return p.groupBy("feature").agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nl") * F.col("nb")))).alias("mi"))


def autocorrelation(df: DataFrame, series: str, t: str, y: str, lags: int = 36) -> DataFrame:
    """Autocorrelation to ``lags`` with Bartlett's 95 % band, long form (series, lag, acf, band)."""
    w = Window.partitionBy(series)
    o = w.orderBy(t)
    d = df.withColumn("_c", F.col(y) - F.avg(y).over(w))
    d = d.select(series, "_c", *[F.lag("_c", k).over(o).alias(f"_l{k}") for k in range(1, lags + 1)])
    s = d.groupBy(series).agg(F.count(F.lit(1)).alias("n"), *[(F.sum(F.col("_c") * F.col(f"_l{k}")) / F.sum(F.col("_c") * F.col("_c"))).alias(f"r{k}") for k in range(1, lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("acf")) for k in range(1, lags + 1)])
    out = s.select(series, "n", F.inline(rows)).where(F.col("acf").isNotNull())
    before = o.partitionBy(series).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(before), F.lit(0.0))
    return out.withColumn("band", F.lit(1.959963984540054) * F.sqrt((1 + 2 * past) / F.col("n")))


def partial_autocorrelation(acf: DataFrame, series: str, adjusted: bool = True) -> DataFrame:
    """Yule-Walker partial autocorrelation by the Durbin-Levinson recursion over one series' few lags."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in acf.schema.fields if f.name == series) + ", lag int, pacf double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        n = float(pdf["n"].iloc[0])
        r = pdf["acf"].to_numpy()
        if adjusted:
            r = r * n / (n - pdf["lag"].to_numpy())
        out, phi = [], np.zeros(0)
        for k in range(1, len(r) + 1):
            top = r[k - 1] - (phi * r[k - 2::-1][:k - 1]).sum() if k > 1 else r[0]
            bot = 1.0 - (phi * r[:k - 1]).sum()
            a = top / bot
            phi = np.concatenate([phi - a * phi[::-1], [a]])
            out.append(a)
        return pd.DataFrame({series: pdf[series].iloc[0], "lag": pdf["lag"].to_numpy(), "pacf": out})

    return acf.groupBy(series).applyInPandas(run, schema)


ADF_CRITICAL_5 = -2.86  # fixed value: 5 % critical value with a constant, large samples


def dickey_fuller(df: DataFrame, series: str, t: str, y: str, lags: int = 1) -> DataFrame:
    """Dickey-Fuller statistic with a constant at a fixed lag order, and the stationary flag at 5 %.

    Re-aimed: fixed lags and a critical value instead of an information criterion and a tail table.
    """
    w = Window.partitionBy(series).orderBy(t)
    d = df.withColumn("_dy", F.col(y) - F.lag(y).over(w)).withColumn("_y1", F.lag(y).over(w))
    d = d.withColumns({f"_d{k}": F.lag("_dy", k).over(w) for k in range(1, lags + 1)})
    cols = ["_one", "_y1", *[f"_d{k}" for k in range(1, lags + 1)], "_dy"]
    d = d.withColumn("_one", F.lit(1.0)).na.drop(subset=cols)
    # centred per series, so that the sums keep their digits
    ws = Window.partitionBy(series)
    d = d.withColumns({c: F.col(c) - F.avg(c).over(ws) for c in cols[1:]})
    k = len(cols)

    def fn(m):
        xx, xy, yy, n = m[:k - 1, :k - 1], m[:k - 1, k - 1], m[k - 1, k - 1], m[0, 0]
        beta = np.linalg.solve(xx, xy)
        s2 = (yy - beta @ xy) / (n - (k - 1))
        stat = beta[1] / np.sqrt(s2 * np.linalg.inv(xx)[1, 1])
        return [(int(n), float(stat), bool(stat < ADF_CRITICAL_5))]

    kind = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)[series]
    return solve_rows(cross_products(d, cols, [series]), k, [series], f"{series} {kind}, n long, stat double, stationary boolean", fn)


def sampling_distribution(df: DataFrame, key: str, value: str, sizes: Sequence[int], seed: int = 42) -> DataFrame:
    """Spread of the sample mean by sample size against sigma / sqrt(n).

    Rows in hash order are cut into consecutive samples of exactly n rows, so the number of samples
    grows with the table and every row is read once.
    """
    order = row_numbers(df.select(key, F.col(value).alias("x"), unit_hash(key, seed=seed).alias("u")), ["u", key], "pos")
    long = order.select("x", "pos", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size"))
    means = long.groupBy("size", F.floor((F.col("pos") - 1) / F.col("size")).alias("sample")).agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("c")).where("c = size")
    pop = df.agg(F.stddev_pop(value).alias("sigma"))
    out = means.groupBy("size").agg(F.count(F.lit(1)).alias("samples"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    return attach(out, pop).withColumn("expected_se", F.col("_s.sigma") / F.sqrt("size")).drop("_s")


def bootstrap_means(df: DataFrame, key: str, value: str, reps: int) -> DataFrame:
    """Mean per bootstrap replicate, with Poisson(1) weights drawn from the row key and the replicate."""
    r = df.select(key_prefix(key).alias("_p"), F.col(value).alias("x")).select("_p", "x", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    r = r.withColumn("_h", digest(F.col("_p"), F.col("rep"))).withColumn("w", poisson1_of(F.col("_h")))
    return r.groupBy("rep").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))


def bootstrap_interval(means: DataFrame, level: float = 0.95) -> DataFrame:
    """Interval over the replicates (their number is a parameter, so the list is short)."""
    a = (1 - level) / 2
    return means.agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"), F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(1 - a)).alias("high"))


HELD_ROWS = 1 << 18  # rows of a task whose texts are dealt by length together
DRAWS = 32  # replicates whose weights are held at a time


def _weighted_products(reps: int, k: int, seed: int = 42, held: int = HELD_ROWS):
    """Per task and replicate: sums of w x products of all column pairs, w drawn from the row's text and the replicate as ``poisson1_of`` does."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counted(poisson1_edges())
        endings = [f"{r}|{seed}".encode() for r in range(1, reps + 1)]
        total, seen = np.zeros((reps, len(pairs))), np.zeros(len(pairs), bool)

        def add(rows: pa.Table) -> None:
            text = rows.column("_p").cast(pa.large_binary()).combine_chunks()
            off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
            raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
            cols = [rows.column(c).combine_chunks() for c in rows.column_names[1:]]
            there = [np.asarray(c.is_valid()) for c in cols]
            value = [np.where(v, c.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0) for c, v in zip(cols, there)]
            both = [there[i] & there[j] for i, j in pairs]
            seen[:] |= [bool(v.any()) for v in both]
            product = np.stack([np.where(v, value[i] * value[j], 0.0) for (i, j), v in zip(pairs, both)], axis=1)
            size = np.diff(off)
            order = np.argsort(size, kind="stable")
            cut = np.flatnonzero(np.diff(size[order])) + 1
            for part in np.split(order, cut):
                for at in np.array_split(part, -(-len(part) // LANES)):
                    heads = raw[off[at][:, None] + np.arange(size[at[0]])]
                    x = product[at]
                    w, first = np.empty((min(DRAWS, reps), len(at))), 0
                    for r, numbers in enumerate(first_numbers(heads, endings)):
                        w[r - first] = counts(numbers, table)
                        if r + 1 - first == len(w) or r + 1 == reps:
                            total[first:r + 1] += w[:r + 1 - first] @ x
                            first = r + 1

        rest, n = [], 0
        for batch in batches:
            rest.append(batch)
            n += batch.num_rows
            if n >= held:
                add(pa.Table.from_batches(rest))
                rest, n = [], 0
        if n:
            add(pa.Table.from_batches(rest))
        if seen.any():  # any row has the constant column
            sums = [pa.array(total[:, p], mask=np.full(reps, not seen[p])) for p in range(len(pairs))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, reps + 1, dtype=np.int32)), *sums], names=["rep", *[f"m_{i}_{j}" for i, j in pairs]])

    return scan


def bootstrap_coefficients(df: DataFrame, key: Sequence[str], features: Sequence[str], target: str, reps: int) -> DataFrame:
    """Coefficients of the regression on standardised features per replicate, with Poisson(1) weights drawn from the row key and the replicate.

    A task makes the weights of its rows in numpy and hands over one row a replicate; no row is copied.
    """
    z = standardise(df, features)
    cols = ["_one", *[f"{f}_z" for f in features], target]
    k, names = len(cols), list(features)
    text = F.coalesce(F.concat(key_prefix(*key), F.lit("|")), F.lit("")).cast("binary")
    rows = z.select(text.alias("_p"), F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in cols[1:]])
    sums = [f"m_{i}_{j}" for i in range(k) for j in range(i, k)]
    part = rows.mapInArrow(_weighted_products(reps, k), ", ".join(["rep int", *[f"{c} double" for c in sums]]))
    m = part.groupBy("rep").agg(*[F.sum(c).alias(c) for c in sums])

    def fn(mat):
        beta = np.linalg.solve(mat[:k - 1, :k - 1], mat[:k - 1, k - 1])
        return [(f, float(b)) for f, b in zip(names, beta[1:])]

    return solve_rows(m, k, ["rep"], "rep int, feature string, coef double", fn)


def summarise_draws(draws: DataFrame, param: str, chain: str, draw: str, value: str, level: float = 0.95) -> DataFrame:
    """Mean, median, credible interval, R-hat and a batch-means effective size per parameter."""
    a = (1 - level) / 2
    q = exact_quantiles(draws, value, [a, 0.5, 1 - a], [param]).select(param, F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))
    per = draws.groupBy(param, chain).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    g = per.groupBy(param).agg(F.sum("n").alias("draws"), F.avg("n").alias("len"), F.avg("v").alias("w"), F.var_samp("m").alias("bn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    rhat = F.sqrt(((F.col("len") - 1) / F.col("len") * F.col("w") + F.col("bn")) / F.col("w"))
    pos = row_numbers(draws.select(param, chain, draw, value), [draw], "_pos", [param, chain]).join(per.select(param, chain, "n"), [param, chain])
    batch = F.floor(F.sqrt("n"))
    b = pos.withColumn("_size", batch).groupBy(param, chain, F.floor((F.col("_pos") - 1) / F.col("_size")).alias("_k"), "_size").agg(F.avg(value).alias("bm"), F.count(F.lit(1)).alias("c")).where("c = _size")
    bv = b.groupBy(param).agg((F.var_samp("bm") * F.avg("_size")).alias("tau"))
    return g.join(bv, param).join(q, param).select(
        param, "draws", "mean", "median", "low", "high", rhat.alias("rhat"), F.least(F.col("draws") * F.col("w") / F.col("tau"), F.col("draws")).alias("ess"))


def predictive_band(df: DataFrame, series: str, t: str, y: str, draws: int, level: float = 0.9) -> DataFrame:
    """Band of simulated one-step predictions of an AR(1) per time step, over draws of its slope."""
    prev = df.withColumn("_prev", F.lag(y).over(Window.partitionBy(series).orderBy(t))).where(F.col("_prev").isNotNull())
    fit = simple_ols(prev, "_prev", y, [series])
    j = prev.join(fit, series).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    slope = F.col("slope") + F.col("stderr") * standard_normal(series, "draw", seed=7)
    noise = F.col("sigma") * standard_normal(series, F.date_format(t, "yyyy-MM-dd"), "draw", seed=11)
    a = (1 - level) / 2
    s = j.select(series, t, F.col(y).alias("y"), (F.col("intercept") + slope * F.col("_prev") + noise).alias("s"))
    # as many values per time step as there are draws, a parameter
    return s.groupBy(series, t).agg(F.max("y").alias("y"), F.percentile("s", F.lit(a)).alias("low"), F.percentile("s", F.lit(1 - a)).alias("high"))


def conjugate_normal(df: DataFrame, group: str, value: str, prior_mean: float, prior_sd: float, noise_sd: float) -> DataFrame:
    """Posterior of a group mean under a normal prior and known noise (re-aimed: closed form)."""
    s = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    prec = 1 / F.lit(prior_sd) ** 2 + F.col("n") / F.lit(noise_sd) ** 2
    post = (F.lit(prior_mean) / F.lit(prior_sd) ** 2 + F.col("n") * F.col("mean") / F.lit(noise_sd) ** 2) / prec
    return s.withColumns({"posterior_mean": post, "posterior_sd": F.sqrt(1 / prec), "shrinkage": (F.lit(1.0) / F.lit(prior_sd) ** 2) / prec})


def sum_of_squares(df: DataFrame, x: str, y: str) -> DataFrame:
    """SSE, SST and R squared of the least-squares line; SST equals n times the population variance."""
    X, Y = F.col(x), F.col(y)
    m = df.agg(F.regr_count(Y, X).alias("n"), F.regr_sxx(Y, X).alias("sxx"), F.regr_syy(Y, X).alias("sst"), F.regr_sxy(Y, X).alias("sxy"), F.var_pop(Y).alias("v"))
    sse = F.col("sst") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    return m.select("n", sse.alias("sse"), "sst", (1 - sse / F.col("sst")).alias("r2"), (F.abs(F.col("sst") - F.col("n") * F.col("v")) <= 1e-9 * F.col("sst")).alias("identity"))
