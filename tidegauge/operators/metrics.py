"""Evaluation metrics: regression, classification, calibration, ranking and text overlap."""
from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.hashing import key_hash
from tidegauge.functions.scalar import lcs_length, row_items
from tidegauge.operators.aggregates import histogram
from tidegauge.operators.joins import lookup_join
from tidegauge.operators.ordering import attach, exact_quantiles, row_numbers, running_sums
from tidegauge.operators.text import words
from tidegauge.operators.vectors import top_k
from tidegauge.session import settle


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 on an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    return ratio((1 + beta ** 2) * p * r, beta ** 2 * p + r)


# --- regression

def regression_columns(y: Column, pred: Column) -> list[Column]:
    """Aggregate columns mse, rmse, mae, r2 for any ``groupBy``."""
    sq = F.pow(y - pred, 2)
    return [F.count(y).alias("n"), F.avg(sq).alias("mse"), F.sqrt(F.avg(sq)).alias("rmse"), F.avg(F.abs(y - pred)).alias("mae"),
            (1 - F.try_divide(F.sum(sq), F.var_pop(y) * F.count(y))).alias("r2")]


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*regression_columns(F.col(y), F.col(pred)))


def stage_lift(df: DataFrame, y: str, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of the later of two model stages, the earlier one's RMSE, and ``lift``: the share of that RMSE that the stage takes away."""
    was = F.sqrt(F.avg(F.pow(F.col(y) - F.col(before), 2))).alias("rmse_before")
    out = df.groupBy(*by).agg(*regression_columns(F.col(y), F.col(after)), was)
    return out.withColumn("lift", F.try_divide(F.col("rmse_before") - F.col("rmse"), F.col("rmse_before")))


def outlier_sensitivity(df: DataFrame, y: str, pred: str, factor: float = 10.0) -> DataFrame:
    """RMSE and MAE when the label of the row nearest to the median is multiplied by ``factor``."""
    med = exact_quantiles(df, y, [0.5]).select(F.col("q")[0].alias("m"))
    near = F.struct(F.abs(F.col(y) - F.col("_m.m")).alias("gap"), F.col(y).alias("y"), F.col(pred).alias("p"))
    s = attach(df, med, "_m").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col(y) - F.col(pred), 2)).alias("sq"), F.sum(F.abs(F.col(y) - F.col(pred))).alias("ab"), F.min(near).alias("bad"))
    y0, p0 = F.col("bad.y"), F.col("bad.p")
    sq2 = F.col("sq") - F.pow(y0 - p0, 2) + F.pow(y0 * factor - p0, 2)
    ab2 = F.col("ab") - F.abs(y0 - p0) + F.abs(y0 * factor - p0)
    out = s.select(F.sqrt(F.col("sq") / F.col("n")).alias("rmse"), (F.col("ab") / F.col("n")).alias("mae"),
                   F.sqrt(sq2 / F.col("n")).alias("rmse_bad"), (ab2 / F.col("n")).alias("mae_bad"))
    return out.withColumns({"rmse_jump_pct": 100 * (F.col("rmse_bad") / F.col("rmse") - 1), "mae_jump_pct": 100 * (F.col("mae_bad") / F.col("mae") - 1)})


def residuals(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(pred))


def residual_table(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    """One row per prediction: fitted against residual, and against the actual value (parity)."""
    return df.select(*keys, F.col(pred).alias("fitted"), F.col(y).alias("actual"), (F.col(y) - F.col(pred)).alias("residual"))


def residual_histogram(df: DataFrame, y: str, pred: str, bins: int = 40) -> DataFrame:
    return histogram(residuals(df, y, pred), "residual", bins)


# --- classification at a threshold

def confusion(df: DataFrame, label: str, pred: str, levels: Sequence) -> DataFrame:
    """Counts on the full label grid, absent cells 0, from one aggregation."""
    cells = [(a, b) for a in levels for b in levels]
    one = df.agg(*[F.count_if((F.col(label) == a) & (F.col(pred) == b)).alias(f"c{i}") for i, (a, b) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), F.col(f"c{i}").alias("n")) for i, (a, b) in enumerate(cells)])
    return one.select(F.inline(rows))


def binary_columns(label: Column, pred: Column) -> list[Column]:
    """Aggregate columns accuracy, precision, recall, f1 of 0/1 columns for any ``groupBy``."""
    tp = F.count_if((label == 1) & (pred == 1))
    precision, recall = ratio(tp, F.count_if(pred == 1)), ratio(tp, F.count_if(label == 1))
    return [F.avg((label == pred).cast("double")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f_beta(precision, recall).alias("f1")]


def per_class(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, f1 and support of every class in the labels or predictions."""
    hit = (F.col(label) == F.col(pred)).cast("int")
    rows = F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.alias("tp")),
                   F.struct(F.col(pred).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))
    c = df.select(F.inline(rows)).groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return c.select("class", "support", "predicted", "tp", precision.alias("precision"), recall.alias("recall"), f_beta(precision, recall).alias("f1"))


def averaged(classes: DataFrame) -> DataFrame:
    """Macro, micro and weighted averages of a per-class report."""
    s = F.sum("support")
    micro_p, micro_r = ratio(F.sum("tp"), F.sum("predicted")), ratio(F.sum("tp"), s)
    three = ("precision", "recall", "f1")
    m = classes.agg(*[F.avg(c).alias(f"macro_{c}") for c in three], *[(F.sum(F.col(c) * F.col("support")) / s).alias(f"weighted_{c}") for c in three],
                    micro_p.alias("micro_precision"), micro_r.alias("micro_recall"), f_beta(micro_p, micro_r).alias("micro_f1"), s.alias("support"))
    rows = F.array(*[F.struct(F.lit(a).alias("average"), *[F.col(f"{a}_{c}").alias(c) for c in three], F.col("support").alias("support")) for a in ("macro", "micro", "weighted")])
    return m.select(F.inline(rows))


def multilabel_report(df: DataFrame, truth: Sequence[str], pred: Sequence[str]) -> DataFrame:
    """Sample-averaged precision, recall and f1, Hamming loss, exact match, and the share with several tags."""
    total = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    both = sum((F.col(t) * F.col(p) for t, p in zip(truth[1:], pred[1:])), F.col(truth[0]) * F.col(pred[0]))
    wrong = sum(((F.col(t) != F.col(p)).cast("int") for t, p in zip(truth[1:], pred[1:])), (F.col(truth[0]) != F.col(pred[0])).cast("int"))
    p, r = ratio(both, total(pred)), ratio(both, total(truth))
    return df.agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f_beta(p, r)).alias("f1"), (F.avg(wrong) / len(truth)).alias("hamming"),
                  F.avg((wrong == 0).cast("double")).alias("exact_match"), F.avg((total(truth) > 1).cast("double")).alias("several_tags"))


# --- scores: everything starts from counts per distinct score

def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    pos = (F.col(label) == 1).cast("long")
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative tp and fp at every distinct score (predict positive at or above it), with the totals."""
    c = settle(score_counts(df, label, score), "score-counts")
    total = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    r = running_sums(c, [-F.col("score")], {"tp": "pos", "fp": "neg"})
    return attach(r, total, "_t").select("score", "pos", "neg", "tp", "fp", F.col("_t.P").alias("total_pos"), F.col("_t.N").alias("total_neg"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """Rank-sum area: a tie between a positive and a negative counts one half."""
    below = F.col("total_neg") - F.col("fp")
    return curve.agg((F.sum(F.col("pos") * (2 * below + F.col("neg"))) / (2 * F.max("total_pos") * F.max("total_neg"))).alias("roc_auc"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Step-wise sum of precision times the gain in recall; no interpolation."""
    return curve.agg(F.sum(F.col("pos") / F.col("total_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc"))


def curve_points(curve: DataFrame) -> DataFrame:
    return curve.select("score", ratio(F.col("fp"), F.col("total_neg")).alias("fpr"), ratio(F.col("tp"), F.col("total_pos")).alias("tpr"),
                        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 at given thresholds, all from one aggregation."""
    y, s = F.col(label) == 1, F.col(score)
    one = df.agg(F.count_if(y).alias("p"), *[F.count_if(y & (s >= t)).alias(f"tp{i}") for i, t in enumerate(thresholds)], *[F.count_if(s >= t).alias(f"n{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"n{i}").alias("flagged"), F.col("p").alias("p")) for i, t in enumerate(thresholds)])
    d = one.select(F.inline(rows))
    precision, recall = ratio(F.col("tp"), F.col("flagged")), ratio(F.col("tp"), F.col("p"))
    d = d.select("threshold", precision.alias("precision"), recall.alias("recall"), f_beta(precision, recall).alias("f1"))
    best = d.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("t"))
    return attach(d, best).withColumn("is_best", F.col("threshold") == F.col("_s.t")).drop("_s")


def cheapest_threshold(curve: DataFrame, fn_cost: float = 10.0, fp_cost: float = 1.0) -> DataFrame:
    """Observed score with the least total cost; ties go to the smaller threshold."""
    cost = fn_cost * (F.col("total_pos") - F.col("tp")) + fp_cost * F.col("fp")
    return curve.withColumn("cost", cost).agg(F.min(F.struct("cost", F.col("score").alias("threshold"), "tp", "fp", "total_pos")).alias("b")).select(
        "b.threshold", "b.cost", ratio(F.col("b.tp"), F.col("b.tp") + F.col("b.fp")).alias("precision"), ratio(F.col("b.tp"), F.col("b.total_pos")).alias("recall"))


def brier_columns(label: Column, p: Column) -> list[Column]:
    """Aggregate columns brier, reference and skill for any ``groupBy``; the base rate is of the scored set."""
    b, rate = F.avg(F.pow(p - label, 2)), F.avg(label.cast("double"))
    ref = rate * (1 - rate)
    return [b.alias("brier"), ref.alias("brier_ref"), (1 - F.try_divide(b, ref)).alias("skill")]


def brier(df: DataFrame, label: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*brier_columns(F.col(label), F.col(p)))


def murphy(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty over forecast bins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    g = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("f"), F.avg(F.col(label).cast("double")).alias("o"))
    base = df.agg(F.avg(F.col(label).cast("double")).alias("o"), F.count(F.lit(1)).alias("n"))
    s = attach(g, base)
    rel = F.sum(F.col("n") * F.pow(F.col("f") - F.col("o"), 2)) / F.max("_s.n")
    res = F.sum(F.col("n") * F.pow(F.col("o") - F.col("_s.o"), 2)) / F.max("_s.n")
    unc = F.max("_s.o") * (1 - F.max("_s.o"))
    return s.agg(rel.alias("reliability"), res.alias("resolution"), unc.alias("uncertainty"), (rel - res + unc).alias("total"))


def reliability_curve(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Mean forecast and observed rate per quantile bin (bin = number of inner edges below p)."""
    e = exact_quantiles(df, p, [i / bins for i in range(1, bins)])
    b = F.size(F.filter(F.col("_e.q"), lambda v: v < F.col(p)))
    return attach(df, e, "_e").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"))


def compare_splits(df: DataFrame, label: str, p: str, split: str, baseline: str) -> DataFrame:
    """Brier skill and accuracy per split with the relative drop against the baseline split."""
    m = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), *brier_columns(F.col(label), F.col(p)), F.avg(((F.col(p) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))
    base = m.where(F.col(split) == baseline).select("skill", "accuracy")
    return attach(m, base).withColumns({
        "skill_drop_pct": (F.col("_s.skill") - F.col("skill")) / F.abs(F.col("_s.skill")) * 100,
        "accuracy_drop_pct": (F.col("_s.accuracy") - F.col("accuracy")) / F.col("_s.accuracy") * 100}).drop("_s")


def permutation_importance(df: DataFrame, key: str, features: Sequence[str], y: str, score, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Rise in RMSE when one column is shuffled, per feature and repeat.

    The shuffle gives the row of key rank r the value of the row of hash rank r, so it is an equi-join.
    ``score(columns) -> Column`` computes the prediction.
    """
    base = settle(row_numbers(df.select(key, y, *features), [key], "_rank"), "ranked")
    rep = base.select(key, *features, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    rmse = lambda pred: F.sqrt(F.avg(F.pow(F.col(y) - pred, 2)))
    whole = base.agg(rmse(score({f: F.col(f) for f in features})).alias("rmse"))
    out = None
    donor = settle(row_numbers(rep.withColumn("_h", key_hash(key, "repeat", seed=seed)), ["_h", key], "_hr", ["repeat"]).select(
        "repeat", F.col("_hr").alias("_rank"), *[F.col(f).alias(f"_s_{f}") for f in features]), "shuffled")
    # a rank's row meets its donors of all repeats: the rows need no copy a repeat, and neither side goes whole through the driver
    joined = donor.join(base.drop(key).hint("merge"), "_rank")
    for f in features:
        pred = score({g: F.col(f"_s_{g}") if g == f else F.col(g) for g in features})
        row = joined.groupBy("repeat").agg(rmse(pred).alias("_r")).withColumn("feature", F.lit(f))
        out = row if out is None else out.unionByName(row)
    return attach(out, whole).select("feature", "repeat", (F.col("_r") - F.col("_s.rmse")).alias("loss"))


def elbow(curve: DataFrame, k: str, score: str, tolerances: Sequence[float]) -> DataFrame:
    """Smallest k whose score is within each tolerance of the best, from one pass after the maximum."""
    best = curve.agg(F.max(score).alias("best"))
    one = attach(curve, best).agg(*[F.min(F.when(F.col(score) >= F.col("_s.best") - t, F.struct(F.col(k).alias("k"), F.col(score).alias("s")))).alias(f"e{i}") for i, t in enumerate(tolerances)])
    rows = F.array(*[F.struct(F.lit(t).alias("tol"), F.col(f"e{i}.k").alias("elbow_k"), F.col(f"e{i}.s").alias("score_at_elbow")) for i, t in enumerate(tolerances)])
    return one.select(F.inline(rows))


def mask_iou(a: DataFrame, b: DataFrame, image: str, x: str, y: str) -> DataFrame:
    """Mask overlap over pixel rows: both masks hold their set pixels."""
    p = a.select(image, x, y, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(image, x, y, F.lit(0).alias("a"), F.lit(1).alias("b")))
    px = p.groupBy(image, x, y).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return px.groupBy(image).agg(ratio(F.sum(F.col("a") * F.col("b")), F.sum(F.greatest("a", "b"))).alias("iou"))


# --- text pairs: (key, candidate, reference)

OVERLAP = "array<struct<n: int, matched: bigint, cand: bigint, ref: bigint>>"


def count_overlaps(c: pa.Array, r: pa.Array, orders: int) -> pa.Array:
    """(n, matched, cand, ref) of each pair and order. One pair at a time leaves its Arrow batch, so Python holds the grams of one pair and order."""
    matched, cand, ref = (np.zeros((len(c), orders), np.int64) for _ in range(3))
    for i in range(len(c)):
        a, b = row_items(c, i), row_items(r, i)
        for n in range(1, orders + 1):
            y = Counter(zip(*(b[j:] for j in range(n))))
            x = Counter(g for g in zip(*(a[j:] for j in range(n))) if g in y)
            matched[i, n - 1], cand[i, n - 1], ref[i, n - 1] = sum(min(k, y[g]) for g, k in x.items()), max(len(a) - n + 1, 0), max(len(b) - n + 1, 0)
    rows = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(1, orders + 1, dtype=np.int32), len(c))), *(pa.array(v.ravel()) for v in (matched, cand, ref))], names=["n", "matched", "cand", "ref"])
    pa.default_memory_pool().release_unused()  # workers are reused: what a batch needed is not kept
    return pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * orders), rows)


def gram_overlap(pairs: DataFrame, key: str, cand: Column, ref: Column, orders: int) -> DataFrame:
    """Clipped matches and totals per pair and order n = 1..orders, of two token arrays or of the characters of two strings.

    A pair is one row, so its grams are counted inside the row, in Arrow batches: nothing is shuffled.
    """
    def count(c: pa.Array, r: pa.Array) -> pa.Array:
        return count_overlaps(c, r, orders)

    counted = pairs.select(key, F.explode(F.arrow_udf(count, OVERLAP)(cand, ref)).alias("o"))
    return counted.select(key, "o.*").where("cand > 0 or ref > 0")


def word_overlap(pairs: DataFrame, key: str, max_n: int = 4) -> DataFrame:
    return gram_overlap(pairs, key, words("candidate"), words("reference"), max_n)


def bleu(overlap: DataFrame, pairs: DataFrame, key: str, max_n: int = 4) -> DataFrame:
    """Unsmoothed BLEU: zero when any order has no match; brevity penalty exp(1 - r/c) when c <= r."""
    size = pairs.select(key, F.size(words("candidate")).alias("c"), F.size(words("reference")).alias("r"))
    p = overlap.where(F.col("n") <= max_n).groupBy(key).agg(
        F.count_if((F.col("matched") > 0) & (F.col("cand") > 0)).alias("orders"),
        F.sum(F.when(F.col("matched") > 0, F.log(F.col("matched") / F.col("cand")))).alias("logs"))
    bp = F.when(F.col("c") > F.col("r"), 1.0).when(F.col("c") > 0, F.exp(1 - F.col("r") / F.col("c"))).otherwise(0.0)
    score = F.when(F.col("orders") == max_n, bp * F.exp(F.col("logs") / max_n)).otherwise(0.0)
    return size.join(p, key, "left").select(key, bp.alias("brevity_penalty"), score.alias("bleu"))


def chrf(pairs: DataFrame, key: str, order: int = 2, beta: float = 2.0) -> DataFrame:
    """Character F score: precision and recall averaged over orders, blanks removed."""
    side = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    o = gram_overlap(pairs, key, side("candidate"), side("reference"), order)
    m = o.groupBy(key).agg((F.sum(ratio(F.col("matched"), F.col("cand"))) / order).alias("precision"), (F.sum(ratio(F.col("matched"), F.col("ref"))) / order).alias("recall"))
    return m.withColumn("chrf", f_beta(F.col("precision"), F.col("recall"), beta))


def rouge_n(overlap: DataFrame, key: str, n: int) -> DataFrame:
    p, r = ratio(F.col("matched"), F.col("cand")), ratio(F.col("matched"), F.col("ref"))
    return overlap.where(F.col("n") == n).select(key, p.alias("precision"), r.alias("recall"), f_beta(p, r).alias("f1"))


def rouge_l(pairs: DataFrame, key: str) -> DataFrame:
    t = pairs.select(key, words("candidate").alias("c"), words("reference").alias("r"))
    t = t.select(key, F.size("c").alias("nc"), F.size("r").alias("nr"), lcs_length("c", "r").alias("lcs"))
    p, r = ratio(F.col("lcs"), F.col("nc")), ratio(F.col("lcs"), F.col("nr"))
    return t.select(key, "lcs", p.alias("precision"), r.alias("recall"), f_beta(p, r).alias("f1"))


def greedy_vector_match(candidates: DataFrame, references: DataFrame, key: str, vec: str, pair: str) -> DataFrame:
    """Mean best cosine from candidate to reference vectors (precision) and back (recall), per pair.

    Re-aimed: the token vectors are inputs.
    """
    side = lambda q, c, n: top_k(q, c, key, vec, 1, "cosine", by=pair).join(q.select(F.col(key).alias("query_id"), pair), "query_id").groupBy(pair).agg(F.avg("score").alias(n))
    m = side(candidates, references, "precision").join(side(references, candidates, "recall"), pair)
    return m.withColumn("f1", f_beta(F.col("precision"), F.col("recall")))


def perplexity(df: DataFrame, key: str, text: str) -> DataFrame:
    """exp(mean negative log probability) under a corpus unigram model with add-one counts (re-aimed).

    Tokens are counted per document before the counts meet: one word may make up a third of all tokens.
    """
    t = df.select(key, F.explode(words(text)).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
    counts = t.groupBy("w").agg(F.sum("n").alias("c"))
    total = counts.agg((F.sum("c") + F.count(F.lit(1))).alias("d"))
    logs = attach(lookup_join(t, counts, "w"), total)
    lp = F.log((F.col("c") + 1) / F.col("_s.d"))
    return logs.groupBy(key).agg(F.sum("n").alias("tokens"), F.exp(-F.sum(F.col("n") * lp) / F.sum("n")).alias("perplexity"))


# --- ranked retrieval: (query, rank, relevance)

def recall_and_rr(ranked: DataFrame, query: str, rank: str, relevant: Column, total: DataFrame, k: int) -> DataFrame:
    """Recall@k and the reciprocal rank of the first hit (null without one), per query."""
    g = ranked.groupBy(query).agg(F.count_if(relevant & (F.col(rank) <= k)).alias("hits"), F.min(F.when(relevant, F.col(rank))).alias("first"))
    return g.join(total, query, "left").select(query, ratio(F.col("hits"), F.col("total")).alias("recall"), (1.0 / F.col("first")).alias("rr"))


def ndcg(ranked: DataFrame, query: str, rank: str, rel: str, k: int, gain: str = "exp") -> DataFrame:
    """nDCG@k with exponential or linear gain and a log2 discount; the ideal order is of the ranked list."""
    g = F.pow(F.lit(2.0), F.col(rel)) - 1 if gain == "exp" else F.col(rel).cast("double")
    ideal = Window.partitionBy(query).orderBy(F.desc(rel), rank)  # one query's ranked list
    d = ranked.withColumn("_g", g).withColumn("_ideal", F.row_number().over(ideal))
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("_g") / F.log2(F.col(r) + 1)).otherwise(0.0))
    return d.groupBy(query).agg(part(rank).alias("dcg"), part("_ideal").alias("idcg")).withColumn("ndcg", ratio(F.col("dcg"), F.col("idcg")))
