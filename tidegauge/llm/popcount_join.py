"""SimHash near-duplicates by a segment-popcount embedding: grid range-join under Manhattan distance, then exact Hamming distance.

A 64-bit fingerprint is cut into segments of ``width`` bits, and each segment is mapped to its number of ones. One flipped bit moves one
count by one, so the Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. Counts are kept as
thermometer codes (the ones of each segment pushed to its low end): equal counts are equal bits, and the Manhattan distance is the number
of bits in which two codes differ.

Range join: the segments form 2 x radius blocks, and each choice of ``radius`` blocks spans a grid whose cells hold equal counts there. Two
embeddings within the radius differ in at most ``radius`` blocks, so they share a cell of at least one grid: no neighbouring cells need be
visited. Within a cell pairs are cut by the bound and what is left is compared exactly.

Equal fingerprints are one point. A cell hands on a spanning forest of its links, never its pairs; a cell with many points (thousands of
near copies) is compared block against block in as many tasks, and cells with the same points are compared once.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.batches import bounded
from tidegauge.llm.bytewords import LOWER, SPACES, U64, split_words, text_buffer
from tidegauge.llm.graph import components
from tidegauge.llm.nearjoin import EDGES, forest, grouped_batches, in_blocks, pairs_of
from tidegauge.session import settle

BLOCK = 1024  # points of a cell in one block
LONG_SLICE = 256  # bytes; longer slices are hashed one by one
#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (U64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U64(k)) | (x >> U64(64 - k))


def xxh64(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every slice ``raw[start:end]``, all slices at a time."""
    lanes = np.zeros(len(raw) // 8 + 3, np.uint64)
    lanes.view(np.uint8)[:len(raw)] = raw

    def eight(at: np.ndarray) -> np.ndarray:  # little-endian, at any byte
        lane, off = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (lanes[lane] >> off) | ((lanes[lane + 1] << U64(1)) << (U64(63) - off))

    def round_(acc: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _turn(acc + x * P2, 31) * P1

    size, at, s = end - start, start.copy(), U64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), s + P5)
        wide = np.flatnonzero((size >= 32) & (size < LONG_SLICE))
        if len(wide):
            acc = [np.full(len(wide), s + P1 + P2), np.full(len(wide), s + P2), np.full(len(wide), s), np.full(len(wide), s - P1)]
            for k in range(int(size[wide].max()) // 32):
                on = np.flatnonzero(size[wide] // 32 > k)
                for j in range(4):
                    acc[j][on] = round_(acc[j][on], eight(at[wide[on]] + 32 * k + 8 * j))
            x = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for a in acc:
                x = (x ^ round_(np.zeros_like(a), a)) * P1 + P4
            h[wide] = x
            at[wide] += size[wide] // 32 * 32
        h += size.astype(np.uint64)
        short = size < LONG_SLICE
        for _ in range(3):
            on = np.flatnonzero(short & (end - at >= 8))
            h[on] = _turn(h[on] ^ round_(np.zeros(len(on), np.uint64), eight(at[on])), 27) * P1 + P4
            at[on] += 8
        on = np.flatnonzero(short & (end - at >= 4))
        h[on] = _turn(h[on] ^ ((eight(at[on]) & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[on] += 4
        for _ in range(3):
            on = np.flatnonzero(short & (end > at))
            h[on] = _turn(h[on] ^ (raw[at[on]].astype(np.uint64) * P5), 11) * P1
            at[on] += 1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        h ^= h >> U64(32)
    blob = raw.data
    for i in np.flatnonzero(~short):
        h[i] = xxhash.xxh64_intdigest(blob[start[i]:end[i]], seed)
    return h


def spaced_shingles(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words joined by one space, starts, ends, texts of the shingles). A text of fewer words, but not none, is one shingle."""
    w = split_words(raw, off, ~SPACES, hashed=False)
    length = w.end - w.start
    begin = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    joined = raw.take(np.repeat(w.start - begin, length + 1) + np.arange(len(length) + int(length.sum())), mode="clip")
    joined[begin + length] = 0x20
    owner = w.owner
    head = (np.arange(len(begin)) + size <= w.first[owner + 1]) | (np.arange(len(begin)) == w.first[owner])
    first = np.flatnonzero(head)
    last = np.minimum(first + size, w.first[owner[first] + 1]) - 1
    return joined, begin[first], begin[last] + length[last], owner[first]


#: For each byte, its bits as eight lanes of eight bits.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def majority(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n texts: a bit is 1 if it is set in over half the hashes of the text. ``owner`` is sorted; no hashes: zero."""
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    total = np.diff(np.concatenate([head, [len(h)]]))
    parts = -(-total // 255)  # lanes of eight bits hold 255 ones
    first = np.concatenate([[0], np.cumsum(parts)])[:-1]
    cut = np.repeat(head - 255 * first, parts) + 255 * np.arange(int(parts.sum()))
    octets = h.view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(head), 64), np.uint8)
    for k in range(8):
        ones = np.add.reduceat(SPREAD[octets[:, k]], cut).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * k:8 * k + 8] = 2 * np.add.reduceat(ones.astype(np.int64), first, axis=0) > total[:, None]
    out[owner[head]] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def thermometer(fp: np.ndarray, width: int) -> np.ndarray:
    """Ones of each segment of ``width`` bits (2, 4 or 8) pushed to the segment's low end."""
    table = np.array([sum(((1 << (b >> s & ((1 << width) - 1)).bit_count()) - 1) << s for s in range(0, 8, width)) for b in range(256)], np.uint8)
    return table[fp.view(np.uint8)].view(np.uint64)


def grids(radius: int, width: int) -> list[int]:
    """Masks over thermometer codes: every choice of ``radius`` out of 2 x radius blocks of whole segments."""
    edges = [round(k * (64 // width) / (2 * radius)) * width for k in range(2 * radius + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(block, radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


POINTS = T.StructType([T.StructField(c, T.LongType()) for c in ("d", "fp", "code")])


def _scan(size: int, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            raw, off, _ = text_buffer(batch.column("text"))
            joined, start, end, owner = spaced_shingles(LOWER[raw], off, size)
            fp = majority(owner, xxh64(joined, start, end), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(fp.view(np.int64)), pa.array(thermometer(fp, width).view(np.int64))], names=["d", "fp", "code"])

    return scan


def fingerprints(docs: DataFrame, size: int = 3, width: int = 2) -> DataFrame:
    """(d, fp, code) of every row: doc_id, fingerprint of the ``size``-word shingles (XXH64, seed 42), embedding as thermometer code."""
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(size, width), POINTS)


def _join(radius: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, head in grouped_batches(batches, ["key", "lo", "hi"]):
            n = batch.num_rows
            fp, code = (np.asarray(batch.column(c)).view(np.uint64) for c in ("d", "code"))
            b = np.asarray(batch.column("b"))
            within = np.asarray(batch.column("lo")) == np.asarray(batch.column("hi"))
            left, right = [], []
            for i, j in pairs_of(head, n, lambda i, j: within[i] | (b[i] != b[j])):
                near = np.bitwise_count(code[i] ^ code[j]) <= radius  # Manhattan distance: a lower bound
                i, j = i[near], j[near]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
                left.append(i[near])
                right.append(j[near])
            label = forest(n, np.concatenate(left), np.concatenate(right))
            linked = np.flatnonzero(label != np.arange(n))
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[label[linked]])], names=["u", "v"])

    return scan


def links(points: DataFrame, radius: int = 3, width: int = 2) -> DataFrame:
    """(u, v): a spanning forest of every cell's links among the distinct fingerprints of ``points`` (fp, code)."""
    cells = [F.xxhash64(F.lit(g), F.col("code").bitwiseAND(F.lit(m))) for g, m in enumerate(grids(radius, width))]  # meeting cells only add pairs to compare
    members = points.select(F.col("fp").alias("d"), "code", F.explode(F.array(*cells)).alias("key"))
    full = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least"), F.bit_xor(F.xxhash64("d")).alias("x")).where("n > 1")
    once = full.groupBy("n", "least", "x").agg(F.min("key").alias("key"))  # near copies meet in many cells
    # Spark sizes what explode returns by the rows that go in, and would broadcast a point's cells, one row a grid
    sized = members.hint("merge").join(once.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")), "key")
    return in_blocks(sized, "key", ["code"]).mapInArrow(_join(radius), EDGES)


def simhash_components(docs: DataFrame, radius: int = 3, size: int = 3, width: int = 2) -> DataFrame:
    """One row per document row: doc_id, fingerprint (long), component_id, n_alike.

    ``component_id``: least doc_id among everything connected by fingerprints that differ in at most ``radius`` bits, itself included;
    ``n_alike``: rows with the identical fingerprint. A-Z count as a-z, words are runs of bytes other than blanks. A text without words, empty or null,
    has fingerprint zero and is linked like any other; so are ties, which leave a bit at 0. Repeated rows give repeated results. A null
    doc_id comes back null and names no component unless nothing else does. Empty input gives no rows. Other columns are ignored.

    Segments of 2 bits give cells of about 24 bits of entropy: at 20 billion random fingerprints a cell holds about a thousand.
    """
    every = settle(fingerprints(docs, size, width), "fingerprints")
    points = settle(every.groupBy("fp", "code").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("n_alike")), "points")
    label = components(links(points, radius, width))
    part = points.join(label.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = part.groupBy("label").agg(F.min("least").alias("component_id"))
    named = part.join(least, "label").select("fp", "component_id", "n_alike")
    return every.join(named, "fp").select(F.col("d").alias("doc_id"), F.col("fp").alias("fingerprint"), "component_id", "n_alike")
