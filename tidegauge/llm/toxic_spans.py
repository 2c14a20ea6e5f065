"""Toxicity by maximum-scoring segments of token log-odds, calibrated as extreme values.

A token is a word (A-Z lower-cased) or its stem, the first ``STEM`` code points. Its weight is the log-odds ratio between toxic and other
training documents (identical texts count once) under an informative Dirichlet prior (the training rates, worth ``PRIOR`` documents). It is
significant by the greater of the log-odds over their error and the root of the likelihood ratio; the error grows without bound where
the clean count is 0 and the prior small, the likelihood ratio only falls with each clean document.
A significant token scores its weight less ``SHIFT``, every other word ``DRIFT``, so random text drifts down. One pass over
a text finds all maximal scoring segments. A segment's expected count by chance in n words is K n exp(-lambda S); lambda and K come
from the segments of the non-toxic training documents (exponential tail), and a logistic curve over the best segment's expected count,
fitted on the training documents, gives the document's probability.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.batches import bounded
from tidegauge.llm.bytewords import ALNUM, LOWER, Words, split_words, text_buffer, word_hashes
from tidegauge.llm.labelled import training_texts
from tidegauge.session import settle

STEM, PRIOR, DRIFT, SHIFT, LEAST_Z = 4, 50.0, -1.0, 2.0, 4.0
LONG = T.LongType()


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words with their hashes, and the hash of each word's stem."""
    low = LOWER[raw]
    w = split_words(low, off, ALNUM, seed=21)
    begins = np.flatnonzero((raw & 0xC0) != 0x80)  # bytes that start a code point
    nth = np.searchsorted(begins, w.start) + STEM
    cut = np.where(nth < len(begins), begins[np.minimum(nth, len(begins) - 1)], len(raw)) if len(begins) else w.end
    return w, word_hashes(low, w.start, np.minimum(cut, w.end), seed=22)


COUNTS = T.StructType([T.StructField("token", LONG), T.StructField("toxic", LONG), T.StructField("other", LONG)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        raw, off, _ = text_buffer(batch.column("text"))
        w, stems = tokens(raw, off)
        y = np.asarray(batch.column("y")) > 0.5
        token, doc = np.concatenate([w.hashes, stems]), np.tile(w.owner, 2)
        order = np.lexsort((doc, token))
        token, doc = token[order], doc[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])[:len(token)]
        token, toxic = token[new], y[doc[new]]
        value, at = np.unique(token, return_inverse=True)
        a, n = np.bincount(at, toxic, len(value)).astype(np.int64), np.bincount(at, minlength=len(value))
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(a), pa.array(n - a)], names=["token", "toxic", "other"])


@dataclass
class Model:
    token: np.ndarray  # sorted hashes of the significant tokens
    weight: np.ndarray
    rate: float  # lambda
    scale: float  # K
    slope: float
    intercept: float

    def word_scores(self, w: Words, stems: np.ndarray) -> np.ndarray:
        out = np.full(len(stems), DRIFT)
        if len(self.token):
            for h in (w.hashes, stems):
                at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
                out = np.maximum(out, np.where(self.token[at] == h, self.weight[at], DRIFT))
        return out

    def expected(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log of the number of segments of this score that chance puts into n words; without a segment, of the words themselves."""
        words = np.log(np.maximum(n, 1))
        return np.where(score > 0, words + np.log(self.scale) - self.rate * score, words)

    def probability(self, log_expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept - self.slope * log_expected, -30, 30)))


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(from, to, score)`` of a word sequence, given its positive words in order.

    Words between them score ``drift`` each. Linear: a stack of candidate segments with the cumulative score left of and up to each;
    a new segment joins the nearest earlier one that began lower, if it ended lower than the new one ends.
    """
    stack: list[list] = []  # [from, to, cumulative score before, cumulative score after, index of nearest earlier that began lower]
    total, at = 0.0, 0
    for pos, s in scores:
        total += drift * (pos - at)
        new = [pos, pos + 1, total, total + s]
        total += s
        at = pos + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, z, after - before) for a, z, before, after, _ in stack]


def segments(model: Model, column) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    raw, off, _ = text_buffer(column)
    w, stems = tokens(raw, off)
    s = model.word_scores(w, stems)
    hits = np.flatnonzero(s > 0)
    doc = np.searchsorted(w.first, hits, "right") - 1
    out: list[list] = [[] for _ in range(len(off) - 1)]
    cut = np.flatnonzero(np.diff(doc)) + 1
    for part in np.split(np.arange(len(hits)), cut) if len(hits) else []:
        d = doc[part[0]]
        out[d] = maximal_segments(list(zip((hits[part] - w.first[d]).tolist(), s[hits[part]].tolist())), DRIFT)
    return w.counts, out


def likelihood_root(a: Column, b: Column, toxic: float, other: float) -> Column:
    """Root of the likelihood ratio that a token in a of ``toxic`` and b of ``other`` documents has two rates, not one."""
    n = toxic + other
    share = (a + b) / n
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    total = term(a, share * toxic) + term(b, share * other) + term(toxic - a, (1 - share) * toxic) + term(other - b, (1 - share) * other)
    return F.sqrt(F.greatest(2 * total, F.lit(0.0)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 20_000, least_z: float = LEAST_Z) -> Model:
    """Learn from at most ``rows`` labelled documents. Without any, or without a toxic one, every document scores low."""
    sample = settle(training_texts(docs, labels, label, rows).groupBy("text").agg(F.max("y").alias("y")), "train-once")
    n = sample.agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).first()
    toxic, other = float(n["a"] or 0), float(n["n"] - (n["a"] or 0))
    if not toxic or not other:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 5.0, 0.05, 1.0, -4.0)
    all_docs = toxic + other
    counted = sample.select("text", "y").mapInArrow(_count, COUNTS).groupBy("token").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    alpha = (F.col("a") + F.col("b") + 0.5) / all_docs * PRIOR
    x, y = F.col("a") + alpha, F.col("b") + alpha
    odds = F.log(x / (toxic + PRIOR - F.col("a"))) - F.log(y / (other + PRIOR - F.col("b")))
    z = F.greatest(odds / F.sqrt(1 / x + 1 / y), likelihood_root(F.col("a"), F.col("b"), toxic, other))  # w > SHIFT: the toxic rate is the higher one
    # significant in a bounded sample: a few thousand tokens at most
    best = counted.select("token", odds.alias("w"), z.alias("z")).where((F.col("z") >= least_z) & (F.col("w") > SHIFT)).toPandas()
    token = best["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    model = Model(token[order], best["w"].to_numpy(float)[order] - SHIFT, 1.0, 0.05, 1.0, 0.0)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            counts, found = segments(held.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(counts.astype(np.int64)), pa.array([max((s for *_, s in f), default=0.0) for f in found], pa.float64()),
                                              pa.array([len(f) for f in found], pa.int64()), pa.array([sum(s for *_, s in f) for f in found], pa.float64()), batch.column("y")], names=["n", "top", "segments", "total", "y"])

    seen = sample.select("text", "y").mapInArrow(tops, "n long, top double, segments long, total double, y double").orderBy("n", "top", "total", "y").toPandas()  # at most ``rows`` short rows
    clean = seen[seen["y"] < 0.5]
    words = max(float(clean["n"].sum()), 1.0)
    hits = float(clean["segments"].sum())
    least = float(model.weight.min()) if len(model.weight) else 1.0  # the lowest score of a segment
    model.rate = (hits + 1) / (max(float(clean["total"].sum()) - hits * least, 0.0) + 1)  # one more segment, at 1 above the least
    model.scale = (hits + 1) / words * float(np.exp(min(model.rate * least, 50.0)))
    e = model.expected(seen["top"].to_numpy(), seen["n"].to_numpy())
    model.slope, model.intercept = logistic(-e, seen["y"].to_numpy())
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not below 0) and intercept by Newton's method, lightly shrunk so that a clean split stays finite."""
    centre, spread = x.mean(), x.std() or 1.0
    a = np.stack([(x - centre) / spread, np.ones(len(x))], 1)
    b = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (y - p) - ridge * len(x) * b * [1, 0]
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge * len(x), 1e-6])
        step = np.linalg.solve(hess, grad)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(b[0], 0.0) / spread
    return float(slope), float(b[1] - slope * centre)


PASSAGES = "array<struct<from: bigint, to: bigint, score: double, p_value: double>>"


def passages(docs: DataFrame, model: Model, significance: float = 0.05) -> DataFrame:
    """(doc_id, score, passages): the probability of each document, and all its toxic passages with a p-value up to ``significance``.

    Whole texts; a passage is a range ``[from, to)`` of words. A null text is an empty one: no passages, and the score of a text without
    any toxic token. One row per document row; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in bounded(batches):
            counts, found = segments(m, batch.column("text"))
            e = m.expected(np.array([max((s for *_, s in f), default=0.0) for f in found]), counts)
            out = []
            for n, f in zip(counts, found):
                value = -np.expm1(-np.exp(np.minimum(m.expected(np.array([s for *_, s in f]), n), 50))) if f else ()
                out.append([{"from": a, "to": z, "score": s, "p_value": float(v)} for (a, z, s), v in zip(f, value) if v <= significance])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.probability(e)), pa.array(out, kind)], names=["doc_id", "score", "passages"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scan, f"doc_id long, score double, passages {PASSAGES}")
