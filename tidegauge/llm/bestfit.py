"""Best-fit packing of documents into token sequences, certified by dual-feasible bounds and repaired by exchange.

Documents are tokenised once; only longer ones are cut. Pieces are packed by best-fit decreasing inside partitions of bounded size.
A dual-feasible function maps sizes so that no sequence can hold more than 1 of the mapped total; the largest bound over a
family of such functions is a number of sequences that no packing of the partition can go below. A partition that
meets its bound is optimal and done. The others hand the pieces of their emptiest sequences to an exchange: these are dealt anew over
fewer partitions and packed again, until no partition has a gap, one partition is left, or a round gains nothing.
"""
from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.batches import bounded
from tidegauge.session import settle

LENGTH, END = 1024, 2
#: The added token of ``byte_bpe_50k.json``.
ADDED = {"<|endoftext|>": 50256}
#: Pieces in one partition of the packing: about 60 MB of a task's memory.
GROUP = 100_000
ROUNDS = 12
LONG = T.LongType()
PIECES = T.StructType([T.StructField(n, LONG) for n in ("doc_id", "copy", "piece", "start", "length", "ids_crc32")])


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """The byte-level BPE of ``byte_bpe_50k.json``, read from its file of ranks: same ids, less time."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


@lru_cache(maxsize=2)
def plain_encoder(vocabulary: str, added: bool) -> tokenizers.Tokenizer:
    """The vocabulary's json, which lies beside its file of ranks."""
    bpe = tokenizers.Tokenizer.from_file(f"{vocabulary.removesuffix('.tiktoken')}.json")
    bpe.encode_special_tokens = not added
    return bpe


def token_ids(text: str, vocabulary: str, added: bool) -> list[int]:
    """Ids of a text. Runs of very many blanks are beyond the regular expressions of the fast encoder; the json's own takes such texts."""
    bpe = encoder(vocabulary)
    try:
        return bpe.encode(text, allowed_special="all") if added else bpe.encode_ordinary(text)
    except ValueError:
        return plain_encoder(vocabulary, added).encode(text, add_special_tokens=False).ids


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences from the end, the remainder first."""
    first = n % length or length
    return [(0, min(first, n))] + [(s, length) for s in range(first, n, length)]


def tokenised(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, added: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, copy, piece, start, length, ids_crc32 (of the piece's ids, little-endian unsigned 32-bit).

    ``copy`` tells rows of one doc_id with different texts apart (64-bit hash of the text). A null text is an empty one: its only token is ``end``.
    With ``added``, an added token's string inside a text is that token, as the vocabulary's json says; without, it is split as any other text.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            row, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = array("I", token_ids(text, str(vocabulary), added) if text else ())
                ids.append(end)
                data = memoryview(ids.tobytes())
                for k, (s, n) in enumerate(cuts(len(ids), length)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    size.append(n)
                    crc.append(zlib.crc32(data[4 * s:4 * (s + n)]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("copy").take(at)] + [pa.array(x, pa.int64()) for x in (piece, start, size, crc)],
                                             names=[f.name for f in PIECES])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.withColumn("copy", F.xxhash64("text")).select("doc_id", "copy", F.col("text")).mapInArrow(scan, PIECES)


def dual_bound(count: np.ndarray, length: int = LENGTH) -> int:
    """Least number of sequences for ``count[s]`` pieces of each size s, by dual-feasible functions in exact integers.

    Family 1, for each k <= length / 2: sizes above length - k count as a whole sequence, sizes below k as nothing, others as themselves (k = 0: the
    volume). Family 2, for each divisor step k: a size counts floor((k + 1) s / length) of k parts, unless (k + 1) s / length
    is whole, then s / length.
    """
    s = np.arange(len(count), dtype=np.int64)
    best = 0
    for k in range(0, length // 2 + 1):
        value = np.where(s > length - k, length, np.where(s < k, 0, s))
        best = max(best, -(-int((value * count).sum()) // length))
    for k in range(1, 101):
        x = (k + 1) * s
        value = np.where(x % length == 0, s * k, (x // length) * length)
        best = max(best, -(-int((value * count).sum()) // (length * k)))
    return best


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, room left in the sequence) of each piece by best-fit decreasing; ties keep the given order."""
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]  # by room left
    rooms: list[int] = []  # sorted rooms that have a bin
    fills: list[int] = []
    for i, n in zip(order.tolist(), sizes[order].tolist()):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
        else:
            room, b = length, len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += n
        left = room - n
        if left:
            if not open_bins[left]:
                insort(rooms, left)
            open_bins[left].append(b)
    return where, offset, length - np.array(fills, np.int64)[where] if len(sizes) else where


PLACED = T.StructType(PIECES.fields + [T.StructField(n, LONG) for n in ("group", "bin", "offset", "moves")])


def leaving(where: np.ndarray, room: np.ndarray, share: int) -> np.ndarray:
    """The pieces of the emptiest sequences that are not full, up to one piece in ``share`` (at least one sequence)."""
    count = np.bincount(where)
    left = np.zeros(len(count), np.int64)
    left[where] = room
    order = np.argsort(-left, kind="stable")
    go = np.zeros(len(count), bool)
    go[order] = (np.cumsum(count[order]) <= max(len(where) // share, count[order[0]])) & (left[order] > 0)
    return go[where]


def _pack(length: int, share: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "copy", "piece"], kind="stable")
        size = group["length"].to_numpy(np.int64)
        where, offset, room = best_fit(size, length)
        certified = int(where.max()) + 1 == dual_bound(np.bincount(size, minlength=length + 1), length)
        moves = np.zeros(len(size), np.int64) if certified else leaving(where, room, share).astype(np.int64)
        return group.assign(bin=where, offset=offset, moves=moves)[[f.name for f in PLACED]]

    return pack


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP, rounds: int = ROUNDS, share: int = 4) -> DataFrame:
    """Pieces with sequence_id and offset: no sequence holds more than ``length``, and a sequence has no gap before its last piece.

    ``pieces`` has doc_id, copy, piece, start, length, ids_crc32. A partition holds about ``group`` pieces whatever the table's size; each
    exchange takes one piece in ``share`` at most from every partition with a gap, so the next round has fewer partitions, down to one. Each
    round is a written table. Empty input gives no rows; equal rows are packed each by itself.
    """
    pool = settle(pieces, "pieces")
    total = pool.agg(F.count(F.lit(1))).first()[0]
    done, last, sequences = [], None, None
    for r in range(rounds):
        parts = max(1, -(-total // group))
        key = F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(r)), F.lit(parts))
        placed = settle(pool.withColumn("group", key).groupBy("group").applyInPandas(_pack(length, share), PLACED), f"round-{r}")
        first = F.col("offset") == 0  # one row per sequence
        used, moved, total = placed.agg(F.count_if(first), F.count_if(first & (F.col("moves") == 1)), F.coalesce(F.sum("moves"), F.lit(0))).first()
        if sequences is not None and used >= sequences:
            break  # the exchange gained nothing: the round before stands
        if not moved or parts == 1 or r == rounds - 1:
            last = (r, placed)
            break
        done.append((r, placed.where("moves = 0")))
        last, pool, sequences = (r, placed.where("moves = 1")), placed.where("moves = 1").select(*[f.name for f in PIECES]), moved
    out = None
    for r, part in [*done, last]:  # round, partition and bin as one number: no partition has more bins than pieces
        part = part.select("doc_id", "copy", "piece", "start", "length", "ids_crc32", ((F.lit(r) * 2**28 + F.col("group")) * 2**31 + F.col("bin")).cast("long").alias("sequence_id"), "offset")
        out = part if out is None else out.union(part)
    return out


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, added: bool = False) -> DataFrame:
    """Tokenise and pack whole documents; one row per piece. See ``tokenised`` and ``pack``."""
    return pack(tokenised(docs, vocabulary, length, end, added), length)
