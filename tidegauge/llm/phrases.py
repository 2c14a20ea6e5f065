"""Phrase collocations by set-oriented relational mining (SETM).

The occurrence relation R_k holds (piece, position, phrase) of every frequent phrase of k words. It is written sorted by position, in blocks of
about ``BLOCK_BYTES`` of text: one row a block with its positions and phrase numbers (compressed) and the block's list of phrases. Positions
step over piece ends, so neighbouring numbers lie in one piece. One level:

1. merge-join: an occurrence at p and one at p + 1 (both frequent) are an occurrence of the phrase one word longer, named by the pair;
2. group-count: a block's distinct pairs and their counts go, sorted and compressed, in one row for each bucket of pairs; the rows of a bucket
   are summed over all blocks, pairs below the least count go;
3. semi-join: the numbers of frequent pairs go back, one row for each bucket and block, and only their occurrences are written.

So what moves is one entry of a few bytes per block and distinct pair, once, not one row per occurrence or pair. The number of buckets grows
with the table, so that a bucket's pairs fit a task; the commonest phrase has one entry a block. Phrases are compared
as words once (level 1, by text) and as pairs of numbers afterwards, never by hash values. A frequent phrase's parts are all
frequent, so their counts come down the levels with it: ``heads`` and ``tails`` are the counts of its first and last 1, 2, ... words.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.batches import bounded
from tidegauge.llm.bytewords import LOWER, U64, mix, split_words, text_buffer
from tidegauge.session import discard, scratch, settle

BLOCK_BYTES = 4 << 20
#: Bytes of text whose words, and occurrences whose pairs, share a bucket on average.
TEXT_A_BUCKET, PAIRS_A_BUCKET = 16 << 20, 2 << 20
#: Bytes between words: blanks, and the ends of pieces ``[.,;:!?\x0A-\x0D]``.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~PIECE_END
WORD[[0x20, 0x09]] = False

OCCURRENCES = [T.StructField("block", T.LongType()), T.StructField("size", T.LongType()), T.StructField("pos", T.BinaryType()), T.StructField("code", T.BinaryType())]
#: A block's entries of one bucket: ``first`` is the number in the block of the first one, ``data`` holds ``size`` of them.
LIST = [T.StructField("bucket", T.LongType()), T.StructField("block", T.LongType()), T.StructField("first", T.LongType()), T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType())]
#: ``lists``: the words by bucket, ``data`` their numbers in ``langs``, counts and sizes, ``text`` their bytes.
FIRST = T.StructType([*OCCURRENCES, T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("totals", T.ArrayType(T.LongType())),
                      T.StructField("lists", T.ArrayType(T.StructType([f for f in LIST if f.name != "block"] + [T.StructField("text", T.BinaryType())])))])
BLOCKS = T.StructType([*OCCURRENCES, T.StructField("ids", T.BinaryType()), T.StructField("kinds", T.LongType())])
PAIRS = T.StructType(LIST)
#: Frequent phrases (id, f and their parts), and rows (block, kinds, kept) that name those of a block: number in the block and id.
HITS = "id long, f long, {}, block long, kinds long, kept binary"


def slices(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of all slices, one behind the other."""
    begin = np.cumsum(size) - size
    return raw[np.repeat(start - begin, size) + np.arange(int(size.sum()))]


def _as_bytes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, same: np.ndarray, some: int = 1 << 16) -> bool:
    """Whether every slice equals slice ``same`` byte for byte."""
    size = end - start
    if (size != size[same]).any():
        return False
    return all((slices(raw, start[z], size[z]) == slices(raw, start[same[z]], size[z])).all() for z in (slice(k, k + some) for k in range(0, len(start), some)))


def vocabulary(raw: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's (group, bytes), one word of each number). Hashes find equal words, their bytes decide."""
    _, one, code = np.unique(mix(h ^ (group.astype(np.uint64) * U64(0x9E3779B97F4A7C15))), return_index=True, return_inverse=True)
    if (group == group[one[code]]).all() and _as_bytes(raw, start, end, one[code]):
        return code, one
    seen: dict = {}  # two words share a hash
    blob = raw.tobytes()
    code = np.array([seen.setdefault((g, blob[a:z]), len(seen)) for g, a, z in zip(group.tolist(), start.tolist(), end.tolist())])
    return code, np.unique(code, return_index=True)[1]


def _compressed(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, compressed with like bytes of all numbers side by side: high bytes cost next to nothing."""
    return _compressed(b"".join(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns))


def _unpacked(b: bytes, size: int, columns: int = 1) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b, 8 * size * columns, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(columns, 8, size).transpose(0, 2, 1)).view(np.int64).reshape(columns, size)


def _one(*values: object) -> list[pa.Array]:
    return [pa.array([v], pa.binary() if isinstance(v, bytes) else None) for v in values]


def _occurrences(block: int, pos: np.ndarray, code: np.ndarray) -> list[pa.Array]:
    return _one(block, len(pos), _packed(np.diff(pos, prepend=0)), _packed(code))


def _runs(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal numbers."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)])) if len(bucket) else []


def _split(buckets: int):
    """Occurrences of all words, numbered in each block by (bucket, lang, word), and the lists of the blocks' words."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in bounded(batches, limit=BLOCK_BYTES):
            raw, off, _ = text_buffer(batch.column("text"))
            raw = LOWER[raw]
            w = split_words(raw, off, WORD)
            if not len(w.start):
                continue
            lang = batch.column("lang").dictionary_encode()
            owner = w.owner
            ends = np.concatenate([[0], np.cumsum(PIECE_END[raw], dtype=np.int32)])
            apart = (ends[w.start[1:]] > ends[w.end[:-1]]) | (owner[1:] != owner[:-1])
            pos = np.arange(len(owner)) + np.concatenate([[0], np.cumsum(apart)])
            group = np.asarray(lang.indices)[owner]
            code, one = vocabulary(raw, w.start, w.end, group, w.hashes)
            bucket = (mix(w.hashes[one]) % U64(buckets)).astype(np.int64)
            size = w.end[one] - w.start[one]
            text = pa.Array.from_buffers(pa.large_binary(), len(one), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(slices(raw, w.start[one], size))])
            order = np.asarray(pc.sort_indices(pa.table({"bucket": bucket, "tongue": group[one], "text": text}), sort_keys=[("bucket", "ascending"), ("tongue", "ascending"), ("text", "ascending")])).astype(np.int64)
            number = np.empty(len(one), np.int32)
            number[order] = np.arange(len(one), dtype=np.int32)
            code, one, bucket, size = number[code], one[order], bucket[order], size[order]
            tongue, n = group[one], np.bincount(code, minlength=len(one))
            lists = [{"bucket": int(bucket[a]), "first": a, "size": z - a, "data": _packed(tongue[a:z], n[a:z], size[a:z]),
                      "text": _compressed(slices(raw, w.start[one[a:z]], size[a:z]).tobytes())} for a, z in _runs(bucket)]
            yield pa.RecordBatch.from_arrays(
                [*_occurrences(block, pos, code), pa.array([lang.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([np.bincount(group, minlength=len(lang.dictionary)).tolist()]),
                 pa.array([lists], pa.list_(pa.struct([(k, pa.binary() if k in ("data", "text") else pa.int64()) for k in ("bucket", "first", "size", "data", "text")])))], names=[f.name for f in FIRST])
            block += 1

    return scan


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(columns, positions, phrase numbers) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            size = row["size"].as_py()
            yield row, np.cumsum(_unpacked(row["pos"].as_py(), size)[0]), _unpacked(row["code"].as_py(), size)[0]
        pa.default_memory_pool().release_unused()


def merge_join(pos: np.ndarray, code: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences at p and p + 1 of one relation (m phrases): (positions, number of each one's pair, first and second of the distinct pairs)."""
    at = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    pair, local = np.unique(code[at].astype(np.int64) * m + code[at + 1], return_inverse=True)
    return pos[at], local, pair // max(m, 1), pair % max(m, 1)


def block_pairs(row: dict, pos: np.ndarray, code: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """The block's occurrences of pairs and its distinct pairs: (positions, number of each one's pair; bucket, first and second id of the pairs).
    Pairs are numbered by (bucket, first, second)."""
    kinds = row["kinds"].as_py()
    ids = np.cumsum(_unpacked(row["ids"].as_py(), kinds)[0])
    pos, local, a, b = merge_join(pos, code, kinds)
    a, b = ids[a], ids[b]
    bucket = (mix(mix(a.astype(np.uint64)) + b.astype(np.uint64)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")  # ids ascend with the numbers in the block, so pairs already do
    number = np.empty(len(a), np.int64)
    number[order] = np.arange(len(a))
    return pos, number[local], bucket[order], a[order], b[order]


def _pairs(buckets: int):
    """The lists of the blocks' distinct pairs: differences of the first ids, second ids and counts."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pos, code in _blocks(batches):
            _, local, bucket, a, b = block_pairs(row, pos, code, buckets)
            n = np.bincount(local, minlength=len(a))
            runs = _runs(bucket)
            for some in (runs[lo:lo + 512] for lo in range(0, len(runs), 512)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[x]) for x, _ in some], pa.int64()), pa.array([row["block"].as_py()] * len(some), pa.int64()), pa.array([x for x, _ in some], pa.int64()),
                     pa.array([z - x for x, z in some], pa.int64()), pa.array([_packed(np.diff(a[x:z], prepend=0), b[x:z], n[x:z]) for x, z in some], pa.binary())], names=[f.name for f in PAIRS])

    return scan


def _keep(joined: bool, buckets: int = 1):
    """Occurrences of the frequent phrases (``kept``: number in the block and id): of the block's words, or of its adjacent pairs."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pos, code in _blocks(batches):
            n = int(code.max()) + 1
            if joined:
                pos, code, a, *_ = block_pairs(row, pos, code, buckets)
                n = len(a)
            local, ids = np.concatenate([_unpacked(k["kept"], k["kinds"], 2) for k in row["kept"].as_py()], axis=1)
            order = np.argsort(ids)
            number = np.full(n, -1, np.int32)
            number[local[order]] = np.arange(len(local), dtype=np.int32)
            new = number[code]
            on = new >= 0
            yield pa.RecordBatch.from_arrays([*_occurrences(row["block"].as_py(), pos[on], new[on]), *_one(_packed(np.diff(ids[order], prepend=0)), len(ids))], names=[f.name for f in BLOCKS])

    return scan


def _semi_join(blocks: DataFrame, found: DataFrame, path: str, joined: bool, buckets: int = 1) -> DataFrame:
    """The next relation, settled at ``path``: ``found`` (block, kinds, kept) names the frequent phrases of each block."""
    kept = found.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("kinds", "kept")).alias("kept"))
    return settle(blocks.join(kept, "block").mapInArrow(_keep(joined, buckets), BLOCKS), path=path)


def _frequent(rows: list[dict], key: np.ndarray, n: np.ndarray, least: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Of a bucket's lists, one behind the other (entries with equal ``key`` are one phrase): (one entry, count and id of each phrase that occurs
    ``least`` times, (block, kinds, kept) of the lists). Numbers begin with the commonest phrase; those of different buckets differ."""
    _, one, back = np.unique(key, return_index=True, return_inverse=True)
    f = np.zeros(len(one), np.int64)
    np.add.at(f, back, n)
    often = np.flatnonzero(f >= least)
    often = often[np.argsort(-f[often], kind="stable")]
    ids = np.arange(len(often)) * buckets + rows[0]["bucket"]
    of = np.full(len(one), -1)
    of[often] = ids
    found, at = of[back], 0
    kept = []
    for r in rows:
        mine = found[at:at + r["size"]]
        on = np.flatnonzero(mine >= 0)
        at += r["size"]
        if len(on):
            kept.append((r["block"], len(on), _packed(on + r["first"], mine[on])))
    return one[often], f[often], ids, kept


def _hits(f: np.ndarray, ids: np.ndarray, parts: dict[str, pa.Array], kept: list[tuple]) -> pa.Table:
    block, kinds, lists = zip(*kept) if kept else ((), (), ())
    phrases = pa.table({"id": pa.array(ids, pa.int64()), "f": pa.array(f, pa.int64()), **parts})
    return pa.concat_tables([phrases, pa.table({"block": pa.array(block, pa.int64()), "kinds": pa.array(kinds, pa.int64()), "kept": pa.array(lists, pa.binary())})], promote_options="default")


def _count_words(least: int, buckets: int):
    def count(lists: pa.Table) -> pa.Table:
        rows, langs, tongues, counts, texts = lists.to_pylist(), {}, [], [], []
        for r in rows:
            tongue, n, size = _unpacked(r["data"], r["size"], 3)
            text = pa.py_buffer(pa.decompress(r["text"], int(size.sum()), codec="zstd", asbytes=True))
            texts.append(pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), text]))
            tongues.append(np.array([langs.setdefault(g, len(langs)) for g in r["langs"]])[tongue])
            counts.append(n)
        words = pa.concat_arrays(texts).dictionary_encode()
        tongue, word = np.concatenate(tongues), np.asarray(words.indices).astype(np.int64)
        one, f, ids, kept = _frequent(rows, word * len(langs) + tongue, np.concatenate(counts), least, buckets)
        return _hits(f, ids, {"lang": pa.array(list(langs), pa.string()).take(pa.array(tongue[one])), "phrase": words.dictionary.take(pa.array(word[one])).cast(pa.string())}, kept)

    return count


def _count_pairs(least: int, buckets: int):
    def count(lists: pa.Table) -> pa.Table:
        rows = lists.to_pylist()
        a, b, n = np.concatenate([_unpacked(r["data"], r["size"], 3) for r in rows], axis=1)
        ends = np.cumsum([r["size"] for r in rows])
        total = np.cumsum(a)
        a = total - np.repeat(np.concatenate([[0], total[ends[:-1] - 1]]), [r["size"] for r in rows])  # differences begin anew in each list
        second, b = np.unique(b, return_inverse=True)
        one, f, ids, kept = _frequent(rows, a * len(second) + b, n, least, buckets)
        return _hits(f, ids, {"a": pa.array(a[one]), "b": pa.array(second[b[one]])}, kept)

    return count


def _group_count(lists: DataFrame, count, parts: str) -> DataFrame:
    """The frequent phrases of all buckets, and which of them each block has, settled."""
    return settle(lists.groupBy("bucket").applyInArrow(count, HITS.format(parts)).select(*(c.split()[0] for c in HITS.format(parts).split(", "))), "hits")


def _shares(table: DataFrame, size: str, each: int) -> int:
    return -(-(table.agg(F.sum(F.expr(size))).first()[0] or 1) // each)


def levels(docs: DataFrame, least: int = 100, words: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """(C_1 ... C_words, totals). C_k (id, lang, phrase, last, f, heads, tails; from C_2 on a, b: the ids of its first and last k - 1
    words) holds every phrase of k words with f >= least; totals (lang, total) counts all words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    buckets = _shares(rows, "octet_length(text)", TEXT_A_BUCKET)
    spark = docs.sparkSession
    relations = [scratch(spark, "occurrences") for _ in range(words)]  # each is deleted once the next one lies written
    blocks = settle(rows.mapInArrow(_split(buckets), FIRST), path=relations[0])
    totals = settle(blocks.select(F.explode(F.arrays_zip("langs", "totals")).alias("g")).groupBy(F.col("g.langs").alias("lang")).agg(F.sum("g.totals").alias("total")), "totals")
    hits = _group_count(blocks.select("block", "langs", F.inline("lists")), _count_words(least, buckets), "lang string, phrase string")
    c = hits.where("id is not null").select("id", "lang", "phrase", F.col("phrase").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    out = [c]
    occurrences = _semi_join(blocks.select("block", "size", "pos", "code"), hits, relations[1], False) if words > 1 else None
    discard(spark, relations[0])
    for k in range(2, words + 1):
        buckets = _shares(occurrences, "size", PAIRS_A_BUCKET)
        hits = _group_count(occurrences.mapInArrow(_pairs(buckets), PAIRS), _count_pairs(least, buckets), "a long, b long")
        front = c.select(F.col("id").alias("a"), "lang", "phrase", "heads")
        back = c.select(F.col("id").alias("b"), "last", "tails")
        longer = settle(hits.where("id is not null").join(front, "a").join(back, "b").select(
            "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("heads", F.array("f")).alias("heads"),
            F.concat("tails", F.array("f")).alias("tails"), "a", "b"), "phrases")
        out.append(longer)
        if k < words:
            occurrences = _semi_join(occurrences, hits, relations[k], True, buckets)
        discard(spark, relations[k - 1])
        c = longer
    return out, totals


def collocations(docs: DataFrame, least: int = 100, words: int = 5) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, cut, dropped): every phrase of 2 to ``words`` words that occurs ``least`` times or more in its lang.

    Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words; a null lang is ``und``, null
    texts have no words. a: occurrences, overlaps included; n: all words of the lang; ``cut``: the number of words of the first part where
    floor(1000 a n / (l r)) is least (smallest of ties), l and r the occurrences of the two parts. ``dropped``: a longer phrase of the result holds
    the phrase's words side by side as often. (Each occurrence of a longer phrase is one of the shorter, so only one word more need be
    looked at: what lies between has the same count.) Repeated rows count each. No rows, or none with words, give no rows. Other columns are ignored.
    """
    found, totals = levels(docs, least, words)
    parts = []
    for k, c in enumerate(found[1:], 2):
        cuts = F.array(*[F.struct(F.expr(f"(1000 * cast(f as decimal(18,0)) * cast(total as decimal(18,0))) div (cast(heads[{i - 1}] as decimal(19,0)) * cast(tails[{k - i - 1}] as decimal(19,0)))").alias("score"),
                                  F.lit(i).alias("cut"), F.col("heads")[i - 1].alias("l"), F.col("tails")[k - i - 1].alias("r")) for i in range(1, k)])
        scored = c.join(totals, "lang").withColumn("best", F.array_min(cuts))
        if k < words:
            inside = found[k].select(F.col("a").alias("id"), F.col("f").alias("g")).union(found[k].select("b", "f")).groupBy("id").agg(F.max("g").alias("g"))
            scored = scored.join(inside, "id", "left")
        else:
            scored = scored.withColumn("g", F.lit(None).cast("long"))
        parts.append(scored.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", F.col("total").alias("n"), "best.score", "best.cut", F.coalesce(F.col("g") >= F.col("f"), F.lit(False)).alias("dropped")))
    return reduce(DataFrame.union, parts)


def top(found: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best of each lang that aren't dropped, with ``rank``: by score and count, largest first, then phrase in byte order.
    A lang's phrases are ranked in shares first, so that no task sorts all of them."""
    shares = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.where("not dropped").withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= limit)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= limit).drop("share")
