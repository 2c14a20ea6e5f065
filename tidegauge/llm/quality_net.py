"""Quality classifier: a convolutional network over the bytes of a whole text, in numpy.

A text is its UTF-8 bytes, padded with zeros to whole hops. Filters of ``WIDTH`` bytes are tables of one weight per offset and byte
(the same as filters over one-hot bytes). Chunks of two hops overlap by one; in each chunk every filter is max-pooled after a
rectifier, and one more channel, the self-match, gives the largest share of bytes equal to the byte a fixed lag before. The
mean and the maximum of every channel over all chunks meet in one logistic unit. All weights are learned together with Adam;
a pooled maximum passes its gradient to the one position it came from.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.batches import bounded
from tidegauge.llm.bytewords import text_buffer
from tidegauge.llm.labelled import training_texts

HOP, WIDTH, FILTERS = 128, 6, 16
LAGS = range(2, 26)


@dataclass
class Net:
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # mean and maximum of FILTERS + 1 channels
    offset: np.ndarray  # (1,)
    learned = False  # from texts of both classes

    @staticmethod
    def start(seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        return Net(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                   rng.normal(0, 0.1, 2 * (FILTERS + 1)).astype(np.float32), np.zeros(1, np.float32))


def padded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first hop of each text and the end): each text has zeros behind it up to whole hops, enough to keep filters and lags inside it."""
    size = np.diff(off)
    hops = -(-(size + max(WIDTH, LAGS[-1])) // HOP)
    first = np.concatenate([[0], np.cumsum(hops)])
    out = np.zeros(first[-1] * HOP, np.uint8)
    out[np.arange(len(raw)) + np.repeat(first[:-1] * HOP - off[:-1], size)] = raw
    return out, first


def self_match(x: np.ndarray) -> np.ndarray:
    """Per hop: the largest share, over the lags, of bytes that equal the byte so far before; padding counts as no match."""
    best = np.zeros(len(x) // HOP, np.uint8)
    eq = np.empty(len(x), np.uint8)
    some = (x != 0).view(np.uint8)
    for lag in LAGS:
        eq[:lag] = 0
        np.equal(x[lag:], x[:-lag], out=eq[lag:].view(bool))
        eq &= some
        np.maximum(best, eq.reshape(-1, HOP).sum(1, dtype=np.uint8), out=best)
    return best.astype(np.float32) / HOP


def convolve(net: Net, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(hops, HOP, FILTERS). Windows that would reach into the next text see zeros there."""
    n = len(x)
    out = net.tables[0][x]
    for k in range(1, WIDTH):
        out[:n - k] += net.tables[k][x[k:]]
    for back in range(1, WIDTH):
        out[first[1:] * HOP - back] = net.tables[:, 0].sum(0)
    out += net.bias
    return out.reshape(-1, HOP, FILTERS)


def pool(net: Net, hops: np.ndarray, first: np.ndarray) -> dict:
    """From the channels of hops to one probability per text; keeps what the gradient needs."""
    last = first[1:] - 1
    after = np.minimum(np.arange(len(hops)) + 1, np.repeat(last, np.diff(first)))  # a text's last chunk is one hop
    second = hops[after] > hops
    chunks = np.where(second, hops[after], hops)
    mean = np.add.reduceat(chunks, first[:-1]) / np.diff(first)[:, None]
    top = np.maximum.reduceat(chunks, first[:-1])
    x = np.concatenate([mean, top], 1)
    z = x @ net.weights + net.offset[0]
    return {"after": after, "second": second, "chunks": chunks, "top": top, "x": x, "p": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}


def score_bytes(net: Net, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    x, first = padded(raw, off)
    hops = np.maximum(convolve(net, x, first).max(1), 0)
    return pool(net, np.concatenate([hops, self_match(x)[:, None]], 1), first)["p"].astype(np.float64)


def gradients(net: Net, raw: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Net:
    x, first = padded(raw, off)
    conv = convolve(net, x, first)
    place = conv.argmax(1)
    peak = np.take_along_axis(conv, place[:, None], 1)[:, 0]
    f = pool(net, np.concatenate([np.maximum(peak, 0), self_match(x)[:, None]], 1), first)
    dz = ((f["p"] - y) * weight / weight.sum()).astype(np.float32)
    c = FILTERS + 1
    text = np.repeat(np.arange(len(y)), np.diff(first))
    is_top = f["chunks"] == f["top"][text]
    ties = np.add.reduceat(is_top.astype(np.float32), first[:-1])
    back = dz[text, None] * (net.weights[:c] / np.diff(first)[text, None] + is_top * net.weights[c:] / ties[text])
    hop = np.zeros_like(back)
    np.add.at(hop, (np.where(f["second"], f["after"][:, None], np.arange(len(back))[:, None]), np.arange(c)), back)
    back = hop[:, :FILTERS] * (peak > 0)
    at = place + np.arange(len(place))[:, None] * HOP
    end = first[1:][text, None] * HOP
    tables = np.zeros_like(net.tables)
    filters = np.broadcast_to(np.arange(FILTERS), at.shape)
    for k in range(WIDTH):
        np.add.at(tables[k], (np.where(at + k < end, x[np.minimum(at + k, len(x) - 1)], 0), filters), back)
    return Net(tables, back.sum(0), f["x"].T @ dz, dz.sum(keepdims=True))


def train(texts: list[bytes], y: np.ndarray, epochs: int = 5, batch: int = 24, rate: float = 0.01, seed: int = 5) -> Net:
    """Adam on cross-entropy with the classes as they come; deterministic for a given order of texts. No texts: an untrained net."""
    net, rng = Net.start(seed), np.random.default_rng(seed)
    if not len(texts):
        return net
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    net.offset[0] = np.log(share / (1 - share))
    names = [f.name for f in fields(Net)]
    m, v = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            some = order[lo:lo + batch]
            raw = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])])
            grad = gradients(net, raw, off, y[some], np.ones(len(some), np.float32))
            step += 1
            now = rate * (1 - step / (steps + 1))
            for n in names:
                g = getattr(grad, n)
                m[n] += 0.1 * (g - m[n])
                v[n] += 0.002 * (g * g - v[n])
                getattr(net, n)[...] -= now * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.998**step)) + 1e-7)
    net.learned = bool(y.min() < y.max())
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 4000) -> Net:
    """Train on at most ``rows`` labelled documents (their whole texts come to the driver: about 15 MB at usual lengths)."""
    sample = training_texts(docs, labels, label, rows).orderBy("d").toPandas()
    return train([t.encode() for t in sample["text"]], sample["y"].to_numpy(np.float32))


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def scores(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score) of every document row, from its whole text. A null text scores as an empty one; nothing else is read."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, limit=256 << 10):
            raw, off, _ = text_buffer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_bytes(held.value, raw, off))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCORES)


def keep_good(docs: DataFrame, net: Net, threshold: float = 0.7) -> DataFrame:
    """Documents that score at least ``threshold``; all columns, whatever their names and types. A net that learned nothing rejects none."""
    if not net.learned:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(net)

    def judge(text: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([text], names=["text"])
        out = [score_bytes(held.value, *text_buffer(b.column("text"))[:2]) for b in bounded(iter([rows]), limit=256 << 10)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.where(F.arrow_udf(judge, "double")(F.col("text").cast("string")) >= threshold)
