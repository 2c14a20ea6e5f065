"""Substring deduplication by seed and extend.

Seeds: of the grams of ``gram`` words inside a window of ``size`` words, the one with the least hash (leftmost of equals) is
the window's anchor (winnowing), so equal windows have equal anchors and only about a sixth of all positions are anchors.
Documents are joined on anchors; an anchor in one document only is dropped. Around each shared anchor the match is
extended word by word to both sides as far as the windows of that anchor reach; windows are compared by 88 bits (64 of the
window's hash and 24 of its anchor's, two independent functions). Overlapping repeated windows join to maximal repeats, whose words are cut from
every document but the one with the smallest doc_id.

Skew: a batch keeps one row for each anchor or window it holds (the smallest doc_id), and decides the others by itself, so
a passage that a third of all documents share meets in one group with one row a batch, not a row a document. Identical
texts (by MD5) are settled first: all windows of a copy repeat, so copies seed nothing.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.batches import bounded
from tidegauge.llm.bytewords import SPACES, U64, Words, mix, runs, split_words, text_buffer, window_starts, windows

LONG = T.LongType()
ALL = -1


def anchor_of_windows(w: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, place of each window's anchor, gram hashes of all places, window hashes of the starts)."""
    total = len(w.hashes)
    ok = np.flatnonzero(window_starts(w.first, size, total))
    g = windows(w.hashes, gram)
    if not len(ok):
        return ok, ok, g, np.zeros(0, np.uint64)
    reach = size - gram + 1
    least = g[ok].copy()
    place = ok.copy()
    for j in range(1, reach):
        x = g[ok + j]
        less = x < least
        least[less] = x[less]
        place[less] = ok[less] + j
    full = windows(w.hashes, size, 0x2545F4914F6CDD1D)
    return ok, place, g, full[ok]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _first_of(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id among the entries with the same key, for each entry."""
    order = np.lexsort((ids, keys))
    k = keys[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    out = np.empty(len(ids), ids.dtype)
    out[order] = np.repeat(ids[order][head], np.diff(np.concatenate([head, [len(k)]])))
    return out


ANCHORS = T.StructType([T.StructField("key", LONG), T.StructField("anchor", LONG), T.StructField("d", LONG), T.StructField("known", T.BooleanType())])


def _anchors(size: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            raw, off, _ = text_buffer(batch.column("text"))
            w = split_words(raw, off, SPACES_INVERSE)
            _, place, g, _ = anchor_of_windows(w, size, gram)
            place = np.unique(place)
            ids = np.asarray(batch.column("d"))[w.owner[place]]
            a = g[place]
            order = np.lexsort((ids, a))
            a, ids = a[order], ids[order]
            fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (ids[1:] != ids[:-1])])[:len(a)]
            a, ids = a[fresh], ids[fresh]  # one row per anchor and document
            first = _first_of(a, ids)
            last = -_first_of(a, -ids)
            known = first < last
            key = np.where(ids == first, a, mix(a ^ ids.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array(_signed(a)), pa.array(ids), pa.array(known)], names=["key", "anchor", "d", "known"])

    return scan


SPACES_INVERSE = ~SPACES
CHECK = U64(2**24 - 1)  # bits of the anchor's hash beside the window's
#: ``at``: word position * 2^32 + number of consecutive windows; negative (-1 - at) if the batch has decided them.
REPEATS = T.StructType([T.StructField(n, LONG) for n in ("key", "h", "d", "t", "at")])


def flat(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(d, t, text, seeds) of the documents that have seeds."""
    batch = batch.filter(batch.column("seeds").is_valid())
    return pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), pa.compute.struct_field(batch.column("row"), "text").cast(pa.string()), batch.column("seeds")],
                                      names=["d", "t", "text", "seeds"])


def _extend(size: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(flat(b) for b in batches):
            raw, off, _ = text_buffer(batch.column("text"))
            w = split_words(raw, off, SPACES_INVERSE)
            starts, place, g, full = anchor_of_windows(w, size, gram)
            seeds = batch.column("seeds")
            seed_doc = np.repeat(np.arange(len(seeds)), np.asarray(seeds.value_lengths()))
            seed = np.asarray(seeds.flatten()).view(np.uint64)
            doc = w.owner[place]
            salt = lambda n: mix(n.astype(np.uint64) + U64(1))  # noqa: E731  the document's number joins the hash: one lookup for the batch
            shared = np.isin(g[place] ^ salt(doc), seed ^ salt(seed_doc))
            starts, doc, h, a = starts[shared], doc[shared], full[shared], g[place[shared]]
            ids = np.asarray(batch.column("d"))[doc]
            both = mix(h ^ (a * U64(0x9E3779B97F4A7C15)))
            known = _first_of(both, ids) < ids
            pos = starts - w.first[doc]
            texts = np.asarray(batch.column("t"))
            at = pos << 32
            # decided here: runs of windows, under keys of their own
            k = np.flatnonzero(known)
            head = np.flatnonzero(np.concatenate([[True], (np.diff(starts[k]) != 1) | (np.diff(doc[k]) != 0)])) if len(k) else k
            n = np.diff(np.concatenate([head, [len(k)]]))
            k = k[head]
            u = np.flatnonzero(~known)
            rows = np.concatenate([k, u])
            yield pa.RecordBatch.from_arrays([
                pa.array(_signed(np.concatenate([mix(ids[k].view(np.uint64) + pos[k].astype(np.uint64)), h[u]]))),
                pa.array(_signed(a[rows] & CHECK)), pa.array(ids[rows]), pa.array(texts[doc[rows]]), pa.array(np.concatenate([-1 - (at[k] + n), at[u] + 1])),
            ], names=[f.name for f in REPEATS])

    return scan


def copies(docs: DataFrame) -> DataFrame:
    """(d, t) of the documents whose whole text a document with a smaller doc_id has."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("t"), F.md5(text.cast("binary")).alias("m")).where("d is not null and m is not null")
    several = rows.groupBy("m").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most")
    return rows.join(several, "m").where("d > least").select("d", "t")


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows by doc_id. Both joins below read this one form, so that Spark moves the texts once."""
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def repeats(docs: DataFrame, size: int = 13, gram: int = 5) -> DataFrame:
    """Windows of ``size`` words whose word sequence also starts in a document with a smaller doc_id.

    Returns (d, t, pos, n): doc_id, ``xxhash64`` of the text, and ``n`` consecutive window starts from word ``pos`` (``ALL``: every window). Documents
    with a null doc_id or text take no part. Rows that repeat a doc_id are judged each by its own text against smaller doc_ids.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).where("d is not null and text is not null")
    group = Window.partitionBy("key", "anchor")
    seeds = (
        keyed.mapInArrow(_anchors(size, gram), ANCHORS)
        .withColumns({"a": F.min("d").over(group), "z": F.max("d").over(group)})
        .where("known or a < z").select("d", "anchor").groupBy("d").agg(F.collect_list("anchor").alias("seeds"))
    )
    copied = copies(docs)
    seeds = seeds.join(copied.groupBy("d").agg(F.collect_list("t").alias("copied")), "d", "left")
    own = F.when(F.array_contains(F.coalesce("copied", F.array().cast("array<bigint>")), F.col("t")), F.lit(None)).otherwise(F.col("seeds"))
    found = _rows(docs).join(seeds, "d", "left").withColumn("seeds", own).drop("copied").mapInArrow(_extend(size, gram), REPEATS)
    judged = found.withColumn("a", F.min("d").over(Window.partitionBy("key", "h"))).where("at < 0 or a < d")
    at = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))
    some = judged.select("d", "t", F.shiftright(at, 32).cast("int").alias("pos"), at.bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("n"))
    return some.union(copied.select("d", "t", F.lit(0).alias("pos"), F.lit(ALL).alias("n")))


def _cut_texts(raw: np.ndarray, off: np.ndarray, valid: np.ndarray, spans: pa.Array, size: int) -> list[pa.Array]:
    """Texts without the covered words, word counts, removed counts, removed word ranges."""
    w = split_words(raw, off, SPACES_INVERSE, hashed=False)
    step = np.zeros(len(w.start) + 1, np.int64)
    owner = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths().fill_null(0)))
    marks = spans.flatten()
    if len(marks):
        n = np.asarray(marks.field("n")).astype(np.int64)
        n = np.where(n == ALL, np.maximum(w.counts[owner] - size + 1, 0), n)
        owner, begin, n = owner[n > 0], (w.first[owner] + np.asarray(marks.field("pos")))[n > 0], n[n > 0]
        np.add.at(step, begin, 1)
        np.add.at(step, begin + n + size - 1, -1)
    gone = np.cumsum(step)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    lost = total[w.first[1:]] - total[w.first[:-1]]
    blob, out, ranges = raw.tobytes(), [], []
    for i in range(len(valid)):
        if not lost[i]:
            out.append(blob[off[i]:off[i + 1]].decode() if valid[i] else None)
            ranges.append([])
            continue
        lo, hi = w.first[i], w.first[i + 1]
        a, z = runs(gone[lo:hi])
        ranges.append([[int(x), int(y)] for x, y in zip(a, z)])
        kept, at = [], off[i]
        for x, y in zip(a, z):  # a cut goes to the start of the next kept word
            kept.append(blob[at:w.start[lo + x]])
            at = w.start[lo + y] if lo + y < hi else off[i + 1]
        kept.append(blob[at:off[i + 1]])
        out.append(b"".join(kept).decode())
    return [pa.array(out, pa.string()), pa.array(w.counts.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(ranges, pa.list_(pa.list_(pa.int64())))]


def _cut(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pa.RecordBatch.from_arrays([pa.compute.struct_field(b.column("row"), "text").cast(pa.string()), b.column("spans"), b.column("row")], names=["text", "spans", "row"]) for b in batches)
        for batch in bounded(named):
            raw, off, valid = text_buffer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *_cut_texts(raw, off, valid, batch.column("spans"), size)], names=["row", "text", "n_words", "n_removed", "spans"])

    return scan


def remove_repeats(docs: DataFrame, size: int = 13, gram: int = 5) -> DataFrame:
    """Cut every word covered by a repeated window (see ``repeats``); windows are judged on the input.

    Returns one row per document row: ``row`` (struct of all columns as given), text, n_words, n_removed, and ``spans``: the
    removed word ranges ``[from, to)``, which are the maximal repeats. Words are runs of bytes other than blanks. A text without
    removed words comes back unchanged, null texts as null with 0 words; a cut also takes the blanks up to the next
    kept word. Other columns pass through whatever their names.
    """
    spans = repeats(docs, size, gram).groupBy("d").agg(F.collect_list(F.struct("t", "pos", "n")).alias("spans"))
    own = _rows(docs).join(spans, "d", "left").withColumn("spans", F.filter("spans", lambda x: x["t"] == F.col("t")))
    schema = T.StructType([T.StructField("row", docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).schema["row"].dataType), T.StructField("text", T.StringType()),
                           T.StructField("n_words", LONG), T.StructField("n_removed", LONG), T.StructField("spans", T.ArrayType(T.ArrayType(LONG)))])
    return own.mapInArrow(_cut(size), schema)
