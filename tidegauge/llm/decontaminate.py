"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and patterns are brought to one form (A-Z lower-cased, each run of other non-word bytes one space, a space around the
whole), so a window of words is one byte string that starts and ends with a space. The search looks at the block of
``BLOCK`` bytes that ends where the shortest pattern would end: a table of shifts tells how far it may jump without missing
an occurrence; where the shift is 0, the block's bucket names the patterns whose prefix of that length ends in this block,
and a direct comparison of bytes confirms each. The search runs over all texts of a batch in step: each text is cut
into stretches of starting positions, and one numpy operation moves every stretch that still runs.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.batches import bounded
from tidegauge.llm.bytewords import ALNUM, LOWER, U64, mix, runs, split_words, text_buffer
from tidegauge.session import settle

BLOCK = 8
STRETCH = 512
TABLE_BITS = 21
#: Patterns of one search; a larger set of test strings is searched in several parts, each sent to the executors by itself.
PART_WINDOWS = 100_000


class Normal:
    """One byte string for a batch: per text a space, then its words, each followed by a space."""

    def __init__(self, column):
        raw, off, self.valid = text_buffer(column)
        w = split_words(raw, off, ALNUM, hashed=False)
        self.first, self.counts = w.first, w.counts
        low = LOWER[raw]
        inside = ALNUM[raw]
        n_texts = len(off) - 1
        size = np.add.reduceat(np.concatenate([w.end - w.start + 1, [0]]), np.minimum(w.first[:-1], len(w.start))) if n_texts else np.zeros(0, np.int64)
        size = np.where(self.counts > 0, size, 0) + 1
        self.off = np.concatenate([[0], np.cumsum(size)])
        self.bytes = np.full(self.off[-1], 0x20, np.uint8)
        lead = np.arange(1, n_texts + 1)[w.owner] if n_texts else np.zeros(0, np.int64)  # leading spaces before each word
        length = w.end - w.start
        self.start = np.cumsum(np.concatenate([[0], length[:-1] + 1])) + lead if len(length) else np.zeros(0, np.int64)
        self.end = self.start + length
        put = np.ones(self.off[-1], bool)
        put[self.off[:-1]] = False
        put[self.end] = False
        self.bytes[put] = low[inside]


def words_of(text: str | None) -> list[str]:
    """The words of one text (small inputs: test strings)."""
    n = Normal(pa.array([text], pa.string()))
    return [bytes(n.bytes[s:e]).decode() for s, e in zip(n.start, n.end)]


def item_windows(items: pd.DataFrame, size: int) -> pd.DataFrame:
    """(pattern, n, item_id): the windows of ``size`` consecutive words; a shorter item is one window. Duplicates removed."""
    out = []
    for item_id, text in items.itertuples(index=False):
        w = words_of(text)
        n = min(size, len(w))
        out += [(" " + " ".join(w[i:i + n]) + " ", n, item_id) for i in range(len(w) - n + 1) if n]
    return pd.DataFrame(out, columns=["pattern", "n", "item_id"]).drop_duplicates()


def hash_blocks(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> U64(64 - TABLE_BITS)).astype(np.int64)


class WuManber:
    """Search for byte strings of at least ``BLOCK`` bytes, or of any length with a block of fewer bytes."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.short = min(map(len, patterns))
        self.block = min(BLOCK, self.short)
        m, b = self.short, self.block
        self.shift = np.full(1 << TABLE_BITS, m - b + 1, np.int32)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        for end in range(b, m + 1):
            at = hash_blocks(self.load(heads, end))
            np.minimum.at(self.shift, at, m - end)
        key = hash_blocks(self.load(heads, m))
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def load(self, rows: np.ndarray, end: int) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for j in range(end - self.block, end):
            out = (out << U64(8)) | rows[:, j].astype(np.uint64)
        return out

    def find(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, pattern numbers) of all occurrences inside the texts ``data[off[i]:off[i + 1]]``."""
        m, b = self.short, self.block
        room = np.maximum(np.diff(off) - m + 1, 0)  # possible starts in each text
        pieces = -(-room // STRETCH)
        text = np.repeat(np.arange(len(room)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pos = off[text] + nth * STRETCH
        stop = np.minimum(pos + STRETCH, off[text] + room[text])
        limit = off[text + 1] if len(text) else stop
        blob = data.tobytes()
        # one unaligned load of a block at any byte
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(data) + 1,), strides=(1,))
        at_out, pat_out = [], []
        while len(pos):
            x = words[pos + (m - b)].byteswap() >> U64(8 * (8 - b))
            h = hash_blocks(x)
            step = self.shift[h]
            hit = np.flatnonzero(step == 0)
            if len(hit):
                lo, hi = np.searchsorted(self.key, h[hit], "left"), np.searchsorted(self.key, h[hit], "right")
                for i, a, z in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo]):
                    p, end = int(pos[i]), int(limit[i])
                    for k in self.order[a:z]:
                        pattern = self.patterns[k]
                        if p + len(pattern) <= end and blob[p:p + len(pattern)] == pattern:
                            at_out.append(p)
                            pat_out.append(k)
            pos = pos + np.maximum(step, 1)
            on = pos < stop
            pos, stop, limit = pos[on], stop[on], limit[on]
        return np.array(at_out, np.int64), np.array(pat_out, np.int64)


class Finder:
    """All windows of a part of the test strings: one search for full windows, one for each shorter length class."""

    def __init__(self, windows: pd.DataFrame, size: int):
        grouped = windows.groupby(["pattern", "n"], sort=True)["item_id"].agg(list).reset_index()
        self.parts = []
        for _, part in grouped.groupby(grouped["n"].where(grouped["n"] == size, 0)):
            self.parts.append((WuManber([p.encode() for p in part["pattern"]]), part["n"].to_numpy(), part["item_id"].tolist()))

    def search(self, column):
        """Per text with a hit: (row, hit word mask as runs, item ids); plus word counts of all texts."""
        n = Normal(column)
        marks = np.zeros(len(n.start) + 1, np.int64)
        items: dict[int, set] = {}
        for search, sizes, ids in self.parts:
            at, which = search.find(n.bytes, n.off)
            word = np.searchsorted(n.start, at + 1)
            np.add.at(marks, word, 1)
            np.add.at(marks, word + sizes[which] if len(which) else word, -1)
            row = np.searchsorted(n.off, at, "right") - 1
            for r, k in set(zip(row.tolist(), which.tolist())):
                items.setdefault(r, set()).update(ids[k])
        return n, np.cumsum(marks)[:-1] > 0, items


HITS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.LongType())),
])


def _search_part(docs: DataFrame, windows: pd.DataFrame, size: int) -> DataFrame:
    """Hits of one part for every row of ``docs``: its columns but the text, then n_words, spans and items."""
    kept = [c for c in docs.columns if c != "text"]
    finder_data = docs.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(finder_data.value, size)
        for batch in bounded(batches):
            n, hit, items = finder.search(batch.column("text"))
            spans = [[] for _ in range(len(n.counts))]
            for r in items:
                a, z = runs(hit[n.first[r]:n.first[r + 1]])
                spans[r] = [[int(s), int(e)] for s, e in zip(a, z)]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in kept), pa.array(n.counts.astype(np.int64)), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                pa.array([sorted(items.get(r, ())) for r in range(len(n.counts))], pa.list_(pa.int64())),
            ], names=[*kept, "n_words", "spans", "items"])

    return docs.select(*kept, "text").mapInArrow(scan, T.StructType([T.StructField(c, T.LongType()) for c in kept] + HITS.fields[1:]))


def find_items(docs: DataFrame, items: DataFrame, size: int = 13, part_windows: int = PART_WINDOWS) -> DataFrame:
    """Occurrences of the test strings ``items(item_id, text)`` in ``docs(doc_id, text)``.

    Returns one row per document row: doc_id, n_words, ``spans`` (word ranges ``[from, to)`` inside any occurrence, disjoint,
    in order), ``items`` (sorted ids with an occurrence). A null or empty text has no words and no hits; null item texts, and
    items without words, match nothing; repeated documents are searched each by itself; other columns are ignored. An empty
    ``items`` gives documents without hits; empty ``docs`` gives no rows. doc_id need not be unique: where there are so many
    test strings that they are searched in parts, the documents are written with a number for each row, and the parts are joined on it.
    """
    spark = docs.sparkSession
    typed = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # at most one window for each two characters; parts by hash of the id keep each below the bound whatever the table's size
    room = typed.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    parts = max(1, -(-int(room) // part_windows))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if parts > 1:
        slim = settle(slim.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = []
    for p in range(parts):
        rows = typed.where(F.pmod(F.hash("item_id"), F.lit(parts)) == p).toPandas() if parts > 1 else typed.toPandas()
        w = item_windows(rows, size)
        if len(w):
            found.append(_search_part(slim, w, size))
    if not found:
        found.append(_search_part(slim, pd.DataFrame({"pattern": [" \x00 "], "n": [1], "item_id": [-1]}), size))  # counts words only
    if parts == 1:
        return found[0]
    joined = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate(
        F.array_sort("s"), F.expr("cast(array() as array<array<bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)[1] >= x[0]),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], x[1])))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return joined.select("doc_id", "n_words", merged.alias("spans"), "items")


def report(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """``find_items`` as counts; ``contaminated``: there are hits, and they are at least one in ``share`` words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return find_items(docs, items, size).withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """Documents that are not contaminated, with all their columns. Each row is judged by its own text, whatever its doc_id: rows are
    written with a number of their own and matched back by it."""
    numbered = settle(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")), "numbered")
    bad = report(numbered.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text")), items, size, share).where("contaminated").select(F.col("doc_id").alias("at"))
    return numbered.join(bad, "at", "left_anti").select("row.*")
