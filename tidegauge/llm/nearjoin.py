"""Self-join of texts by the Jaccard similarity of their word shingles, with Bayesian pruning of candidates.

Identical texts are one class, compared once. Min-hash values of the classes are cut into bands; classes that agree on a
band meet in a bucket. In a bucket pairs are compared on more and more min-hash values, and a pair is dropped as soon as
the posterior probability that its similarity reaches the threshold (uniform prior, binomial matches) falls below the
tolerance. What survives only says which classes belong together: a bucket hands on a spanning forest of its surviving pairs,
never the pairs, and the components of all forests are then verified exactly, block against block, from the shingle
sets. So a group of very many near copies costs rows in proportion to its blocks, and no bucket is capped.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.batches import bounded
from tidegauge.llm.bytewords import SPACES, U64, Words, mix, split_words, text_buffer, window_starts, windows
from tidegauge.llm.graph import components
from tidegauge.session import settle

BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band with probability (1 - 0.8^4)^24, about 3 in a million
HASHES = BANDS * ROWS
STEP = 16  # min-hash values compared between two decisions
SIGNATURE_BLOCK, TEXT_BLOCK = 512, 256  # classes of a bucket, or of a component, in one block
LONG = T.LongType()


def prune_table(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values: the most matches m with P(similarity >= threshold | m of n) < tolerance; -1: none.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        for k in range(n + 1):
            tail += comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
            if tail >= tolerance:
                break
            m = k
        out[n] = m
    return out


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every ``size`` consecutive words; a text of fewer words, but not none, is one shingle."""
    total = len(w.hashes)
    at = np.flatnonzero(window_starts(w.first, size, total))
    owner = w.owner
    docs, h = owner[at], windows(w.hashes, size)[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            on = w.counts[short] > j
            own[on] = own[on] * U64(0x5851F42D4C957F2D) + w.hashes[w.first[short[on]] + j]
        docs, h = np.concatenate([docs, short]), np.concatenate([h, mix(own + U64(size))])
        order = np.argsort(docs, kind="stable")
        docs, h = docs[order], h[order]
    return docs, h


def minhash(docs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts with shingles, their HASHES least values each); ``docs`` is sorted."""
    if not len(docs):
        return docs, np.zeros((0, HASHES), np.uint32)
    head = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    rng = np.random.default_rng(7)
    factor, offset = (rng.integers(1, 2**63, HASHES, dtype=np.uint64) * U64(2) + U64(1) for _ in range(2))
    out = np.empty((len(head), HASHES), np.uint32)
    bounds = np.concatenate([head, [len(h)]])
    lo = 0
    while lo < len(head):  # pieces that fit a processor's cache
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 32768, "right")) - 1)
        x = h[bounds[lo]:bounds[hi]]
        cut = bounds[lo:hi] - bounds[lo]
        y = np.empty_like(x)
        for j in range(HASHES):
            np.multiply(x, factor[j], out=y)
            y += offset[j]
            out[lo:hi, j] = (np.minimum.reduceat(y, cut) >> U64(32)).astype(np.uint32)
        lo = hi
    return docs[head], out


SIGNATURES = T.StructType([T.StructField("d", LONG), T.StructField("h1", LONG), T.StructField("h2", LONG),
                           T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(LONG))])


def _signatures(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            raw, off, _ = text_buffer(batch.column("text"))
            w = split_words(raw, off, ~SPACES)
            at, least = minhash(*shingles(w, size))
            n = batch.num_rows
            wide = least.astype(np.uint64).reshape(len(at), BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(at), BANDS)).copy()
            for j in range(ROWS):
                key = mix(key ^ wide[:, :, j]) * U64(0x9E3779B97F4A7C15)
            full = np.zeros((n, HASHES), np.uint16)
            full[at] = least.astype(np.uint16)
            sizes = np.zeros(n, np.int32)
            sizes[at] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(mix(key).reshape(-1).view(np.int64)))
            sig = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * HASHES * 2).astype(np.int32)), pa.py_buffer(full.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("d", "h1", "h2")] + [sig, bands], names=[f.name for f in SIGNATURES])

    return scan


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end at a group's end, with the starts of their groups. The input is sorted by ``keys``."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None and rest.num_rows:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        head = _heads(batch, keys)
        last = int(head[-1])
        if last:
            yield batch.slice(0, last), head[:-1]
        rest = batch.slice(last)
    if rest is not None and rest.num_rows:
        yield rest, _heads(rest, keys)


def _heads(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        x = np.asarray(batch.column(k))
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def pairs_of(head: np.ndarray, n: int, keep: Callable, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j inside the groups, in chunks; ``keep(i, j)`` is the caller's mask of pairs that this group owns."""
    end = np.repeat(np.concatenate([head[1:], [n]]), np.diff(np.concatenate([head, [n]])))
    partners = end - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(partners)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + chunk, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), partners[lo:hi])
        j = np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], partners[lo:hi]) + i + 1
        mask = keep(i, j)
        yield i[mask], j[mask]
        lo = hi


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row linked to each of n rows by the pairs."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        m = np.minimum(a, b)
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        on = label[i] != label[j]
        i, j = i[on], j[on]
    return label


EDGES = T.StructType([T.StructField("u", LONG), T.StructField("v", LONG)])


def _candidates(threshold: float, tolerance: float):
    table = prune_table(threshold, tolerance)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, head in grouped_batches(batches, ["key", "lo", "hi"]):
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, HASHES)
            d, b = np.asarray(batch.column("d")), np.asarray(batch.column("b"))
            within = np.asarray(batch.column("lo")) == np.asarray(batch.column("hi"))
            left, right = [], []
            for i, j in pairs_of(head, n, lambda i, j: within[i] | (b[i] != b[j])):
                matches = np.zeros(len(i), np.int16)
                for done in range(0, HASHES, STEP):
                    matches += (sig[i, done:done + STEP] == sig[j, done:done + STEP]).sum(1, dtype=np.int16)
                    on = matches > table[done + STEP]
                    i, j, matches = i[on], j[on], matches[on]
                left.append(i)
                right.append(j)
            label = forest(n, np.concatenate(left), np.concatenate(right))
            linked = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(d[linked]), pa.array(d[label[linked]])], names=["u", "v"])

    return scan


SHINGLES = T.StructType([T.StructField("d", LONG), T.StructField("label", LONG), T.StructField("nb", T.IntegerType()), T.StructField("s", T.ArrayType(LONG))])


def _shingle_sets(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            raw, off, _ = text_buffer(batch.column("text"))
            doc, h = shingles(split_words(raw, off, ~SPACES), size)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[:len(doc)]
            doc, h = doc[new], h[new]
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("d", "label", "nb")] + [pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], names=[f.name for f in SHINGLES])

    return scan


def shared_counts(owner: np.ndarray, h: np.ndarray, n: int, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of n sets, given as (set, member) entries."""
    value, column, count = np.unique(h, return_inverse=True, return_counts=True)
    several = count > 1
    number = np.cumsum(several) - 1
    on = several[column]
    owner, column = owner[on], number[column[on]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(several.sum()), columns):
        a, z = np.searchsorted(column, [lo, lo + columns])
        part = np.zeros((n, min(columns, int(several.sum()) - lo)), np.float32)
        part[owner[a:z], column[a:z] - lo] = 1
        out += part @ part.T
    return out


LINKS = T.StructType([T.StructField("d", LONG), T.StructField("root", LONG), T.StructField("links", LONG)])


def _verify(threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, head in grouped_batches(batches, ["label", "lo", "hi"]):
            d, b = np.asarray(batch.column("d")), np.asarray(batch.column("b"))
            within = np.asarray(batch.column("lo")) == np.asarray(batch.column("hi"))
            s = batch.column("s")
            size = np.asarray(s.value_lengths()).astype(np.int64)
            flat, at = np.asarray(s.flatten()), np.concatenate([[0], np.cumsum(size)])
            root, links = np.arange(len(d)), np.zeros(len(d), np.int64)
            for lo, hi in zip(head, np.concatenate([head[1:], [len(d)]])):
                m = hi - lo
                if m < 2:
                    continue
                common = shared_counts(np.repeat(np.arange(m), size[lo:hi]), flat[at[lo]:at[hi]], m).astype(np.float64)
                union = size[lo:hi, None] + size[None, lo:hi] - common
                near = common >= threshold * union - 1e-9
                near &= d[lo:hi, None] != d[None, lo:hi]
                if not within[lo]:
                    near &= b[lo:hi, None] != b[None, lo:hi]
                links[lo:hi] = near.sum(1)
                root[lo:hi] = lo + forest(m, *np.nonzero(np.triu(near)))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(d[root]), pa.array(links)], names=[f.name for f in LINKS])

    return scan


def in_blocks(df: DataFrame, group: str, others: list[str]) -> DataFrame:
    """Rows dealt to pairs of blocks: block b of ``nb`` meets every block once; sorted by pair inside a partition."""
    b = F.pmod(F.xxhash64("d"), F.col("nb")).cast("int")
    dealt = df.select(group, "d", *others, b.alias("b"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    dealt = dealt.select(group, F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "d", "b", *others)
    return dealt.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "d")


def near_links(docs: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-7) -> DataFrame:
    """One row per document row: doc_id, text_id, class_id, n_links.

    ``text_id``: least doc_id with the identical text; ``n_links``: how many other texts have a similarity of ``threshold`` or
    more with it; ``class_id``: least doc_id among everything connected by such links and identical texts. Words are runs of bytes other than
    blanks. Identical empty texts are one class without links. A null text is like no other: class of its own. Rows with a
    null doc_id get null ids and 0 links and count for no other row. Rows that share a doc_id count as one document, linked as any of
    its texts is. Empty input gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"))
    digest = rows.where("d is not null and text is not null").select("d", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("2"), F.reverse("text")).alias("h2"))
    signed = settle(digest.mapInArrow(_signatures(size), SIGNATURES), "signatures")
    texts = signed.groupBy("h1", "h2").agg(F.min("d").alias("text_id"))
    reps = signed.join(texts.select(F.col("text_id").alias("d")).distinct(), "d", "left_semi").select("d", "sig", "bands")
    members = reps.select("d", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least"), F.bit_xor(F.xxhash64("d")).alias("x")).where("n > 1")
    once = buckets.groupBy("n", "least", "x").agg(F.min("key").alias("key"))  # the same classes often meet in many bands
    sized = members.join(once.select("key", F.ceil(F.col("n") / SIGNATURE_BLOCK).cast("int").alias("nb")), "key")
    meeting = in_blocks(sized.join(reps.select("d", "sig"), "d"), "key", ["sig"])
    label = components(meeting.mapInArrow(_candidates(threshold, tolerance), EDGES))
    nb = F.ceil(F.count(F.lit(1)) / TEXT_BLOCK).cast("int").alias("nb")
    wanted = label.join(label.groupBy("label").agg(nb), "label").select(F.col("v").alias("d"), "label", "nb")
    # repeated rows count once: the join has already brought them together
    once = rows.withColumn("t", F.xxhash64("text")).join(wanted.hint("merge"), "d").dropDuplicates(["d", "t"]).drop("t")
    sets = once.mapInArrow(_shingle_sets(size), SHINGLES)
    verified = settle(in_blocks(sets, "label", ["s"]).mapInArrow(_verify(threshold), LINKS), "links")
    links = verified.groupBy("d").agg(F.sum("links").alias("n_links"))
    classes = components(verified.where("d <> root").select(F.col("d").alias("u"), F.col("root").alias("v")))
    known = texts.join(links.withColumnRenamed("d", "text_id"), "text_id", "left").join(classes.withColumnRenamed("v", "text_id"), "text_id", "left")
    named = signed.select("d", "h1", "h2").join(known, ["h1", "h2"]).select(
        F.col("d").alias("doc_id"), "text_id", F.coalesce("label", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    bare = rows.where("d is null or text is null").select(F.col("d").alias("doc_id"), F.col("d").alias("text_id"), F.col("d").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return named.union(bare)


def keep_one(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id; all columns. Rows without a doc_id stay.

    Rows are told apart by a number of their own, written with them, not by doc_id: different texts under one doc_id stay, and of repeated
    rows one stays. Null texts are like nothing and stay.
    """
    numbered = settle(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")), "numbered")
    named = numbered.where("row.doc_id is not null")
    found = near_links(named.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text")), threshold, size).select(F.col("doc_id").alias("at"), "class_id")
    first = found.join(named.select("at", F.col("row.doc_id").cast("long").alias("d")), "at").groupBy("class_id").agg(F.min(F.struct("d", "at")).alias("first"))
    kept = numbered.join(first.select(F.col("first.at").alias("at")), "at", "left_semi")
    return kept.select("row.*").union(numbered.where("row.doc_id is null").select("row.*"))
