"""Repair of conversation structure by weighted CYK parsing of row intervals.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Repairs are edits: Keep, Rerole (to user or assistant), Delete and
Insert (an empty user or assistant turn). The repair grammar is in Chomsky normal form: ``X_ij`` derives the edits that take the role pattern
from state i to state j, with the binary rules ``X_ij -> X_ik X_kj``, one terminal rule for each edit of a row, and the roots
``X_00`` and ``X_03``. Insertions derive nothing of the input, so each row's cells are closed under them: ``E X E`` with the cheapest insertions
``E_ij`` on both sides.

A span's cell holds the least (cost, audit) of every nonterminal, audit being the edits' initials. Two audits of one span and one cost never
are each other's proper prefix (all more letters would be insertions, which cost), so the order of (cost, audit) survives concatenation and cells
of minima are exact. The grammar has every split: whichever k and wherever a span is cut, the combined cell is the same. So the
chart needs one split a span, and is filled bottom-up by span length, neighbouring spans pairwise: n cells instead of n squared.

Rows are ordered once (range partitions, so a conversation of very many rows is spread over tasks), each partition parses its runs of rows,
and the cells of a conversation's runs combine like other neighbouring spans. Texts are not needed for that; they move once
more, in order, when the repaired turns are written.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import settle

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The role pattern: state, role initial -> state. 0: nothing yet, 1: after s, 2: after u, 3: after a.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROOTS = ((0, 0), (0, 3))
LEGAL = {"su", "ua", "au"}
Cells = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts: every rule X_ij -> X_ik X_kj."""
    out: Cells = {}
    for (i, k), (c, a) in left.items():
        for j in range(4):
            other = right.get((k, j))
            if other is None:
                continue
            cost, best = c + other[0], out.get((i, j))
            if best is None or cost < best[0] or cost == best[0] and a + other[1] < best[1]:
                out[i, j] = (cost, a + other[1])
    return out


def offer(cells: Cells, at: tuple[int, int], cost: int, audit: str) -> None:
    if at not in cells or (cost, audit) < cells[at]:
        cells[at] = (cost, audit)


def _insertions() -> Cells:
    cells: Cells = {(i, i): (0, "") for i in range(4)}
    for _ in range(4):
        for (i, k), (c, a) in list(cells.items()):
            for (x, role), j in MOVES.items():
                if x == k and role in "ua":
                    offer(cells, (i, j), c + INSERT, a + "I")
    return cells


INSERTIONS = _insertions()


@lru_cache(maxsize=None)  # as many as there are row codes
def row_cells(code: str) -> Cells:
    """Cells of one row. ``code``: its role initial (``-`` for any other) and its fault (b, d, t or ``-``)."""
    role, fault = code
    cells: Cells = {(i, i): (DELETE, "D") for i in range(4)}
    if fault not in "bd":
        for (i, x), j in MOVES.items():
            if x == role:
                offer(cells, (i, j), TRUNCATED * (fault == "t"), "K")
            if x in "ua":
                offer(cells, (i, j), REROLE + TRUNCATED * (fault == "t"), "R")
    return combine(combine(INSERTIONS, cells), INSERTIONS)


def span_cells(spans: list[Cells]) -> Cells:
    """Cells of neighbouring spans as one, bottom-up by length. No spans: the insertions alone."""
    while len(spans) > 1:
        spans = [combine(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0] if spans else INSERTIONS


@lru_cache(maxsize=1 << 14)
def _short(codes: str) -> Cells:
    return span_cells([row_cells(codes[i:i + 2]) for i in range(0, len(codes), 2)])


def parse(codes: str) -> Cells:
    """Cells of a run of rows; ``codes`` has two letters a row."""
    return span_cells([_short(codes[i:i + 64]) for i in range(0, len(codes), 64)])


def root(cells: Cells) -> tuple[int, str]:
    return min(cells[r] for r in ROOTS if r in cells)


def visible(text: Column) -> Column:
    """The text without blanks at its end."""
    return F.rtrim(text, F.lit(BLANKS))


def in_order(rows: DataFrame) -> DataFrame:
    """(known, cid, seq, turn, role, text), settled: rows by conversation, turn (nulls first), role and text; ``seq`` grows in this order."""
    rows = rows.select(F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    ordered = rows.repartitionByRange("known", "cid", "turn").sortWithinPartitions("known", "cid", "turn", "role", "text")
    return settle(ordered.withColumn("seq", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """(known, cid, seq, turn, code) of ordered turns, settled: role initial and first fault: blank, duplicate, truncated."""
    own = turns.select("known", "cid", "seq", "turn", "role", visible(F.col("text")).alias("shown"), F.md5(F.col("text").cast("binary")).alias("digest"))
    ends = own.select("known", "cid", "seq", "turn", "role", "digest", (F.col("shown") == "").alias("blank"), F.substring("shown", -1, 1).isin(".", "!", "?").alias("ended"))
    seen = ends.groupBy("known", "cid", "role", "digest").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = ends.join(seen, ["known", "cid", "role", "digest"], "left")
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), "b").when(F.col("seq") > F.col("first"), "d").when(~F.col("ended"), "t").otherwise("-")
    return settle(told.select("known", "cid", "seq", "turn", F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), fault).alias("code")), "faults")


RUNS = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("cid", T.LongType()), T.StructField("at", T.LongType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
                     T.StructField("illegal", T.LongType()), T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))])
PARSED = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("cid", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """((known, cid), values of the columns) of each conversation in a sorted stream."""
    key, held = None, None
    for batch in batches:
        known, cid = batch.column("known").to_pylist(), batch.column("cid").to_pylist()
        values = [batch.column(c).to_pylist() for c in columns]
        for i, here in enumerate(zip(known, cid)):
            if here != key:
                if held:
                    yield key, held
                key, held = here, [[] for _ in columns]
            for h, v in zip(held, values):
                h.append(v[i])
    if held:
        yield key, held


def _chunks(rows: Iterator[tuple], schema: T.StructType, types: list[pa.DataType], size: int = 1000) -> Iterator[pa.RecordBatch]:
    names, held, weight = [f.name for f in schema], [], 0
    for r in rows:
        held.append(r)
        weight += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= size or weight > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


LONGS, STRINGS = pa.list_(pa.int64()), pa.list_(pa.string())


def _illegal(roles: str) -> int:
    return sum(roles[i:i + 2] not in LEGAL for i in range(len(roles) - 1))


def _parse_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (known, cid), (seq, code) in _groups(batches, ["seq", "code"]):
            codes = "".join(code)
            cells, roles = parse(codes), codes[::2]
            found = [cells.get((i, j), (None, None)) for i in range(4) for j in range(4)]
            yield known, cid, seq[0], roles[0], roles[-1], _illegal(roles), [c for c, _ in found], [a for _, a in found]

    return _chunks(rows(), RUNS, [pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), LONGS, STRINGS])


def _combine_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (known, cid), (first, last, illegal, costs, audits) in _groups(batches, ["first", "last", "illegal", "costs", "audits"]):
            spans = [{divmod(k, 4): (c, a) for k, (c, a) in enumerate(zip(cs, aus)) if c is not None} for cs, aus in zip(costs, audits)]
            between = sum(a + b not in LEGAL for a, b in zip(last, first[1:]))
            yield known, cid, sum(illegal) + between, *root(span_cells(spans))

    return _chunks(rows(), PARSED, [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()])


def audits(coded: DataFrame) -> DataFrame:
    """(known, cid, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``coded`` (known, cid, seq, turn, code), settled."""
    by_order = coded.select("known", "cid", "seq", "code").repartitionByRange("known", "cid", "seq").sortWithinPartitions("known", "cid", "seq")
    runs = by_order.mapInArrow(_parse_runs, RUNS)
    parsed = runs.repartition("known", "cid").sortWithinPartitions("known", "cid", "at").mapInArrow(_combine_runs, PARSED)
    fault = F.substring("code", 2, 1)
    of = lambda x: F.count(F.when(fault == x, 1))
    # per turn first: a conversation of very many rows meets as counts
    by_turn = coded.groupBy("known", "cid", "turn").agg(of("b").alias("b"), of("d").alias("d"), of("t").alias("t"))
    counted = by_turn.groupBy("known", "cid").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), F.sum("b").alias("blank"), F.sum("d").alias("duplicate"), F.sum("t").alias("truncated"))
    return settle(counted.join(parsed, ["known", "cid"]), "audits")


TURNS = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("cid", T.LongType()), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        key, audit, at, place, odd = None, "", 0, 0, 0

        def turn(role, text):
            nonlocal place
            place += 1
            return *key, place - 1, audit[at], role, text

        def due():  # the role pattern leaves one role for each place
            return "user" if place % 2 == odd else "assistant"

        for batch in batches:
            for known, cid, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("known", "cid", "audit", "role", "text"))):
                if (known, cid) != key or edits is not None:
                    while at < len(audit):  # insertions after the last row
                        yield turn(due(), "")
                        at += 1
                    key, audit, at, place = (known, cid), edits or "", 0, 0
                    odd = (len(audit) - audit.count("D")) % 2
                    continue
                while audit[at] == "I":
                    yield turn(due(), "")
                    at += 1
                if audit[at] != "D":
                    yield turn(role if audit[at] == "K" else due(), text)
                at += 1
        while at < len(audit):
            yield turn(due(), "")
            at += 1

    return _chunks(rows(), TURNS, [pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])


def _conversation(df: DataFrame) -> Column:
    return F.when(F.col("known"), F.col("cid"))


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(known, cid, place, edit, role, text): the turns left and added, by ``audits`` of the same ordered turns. A conversation's rows lie together and in order."""
    both = turns.select("known", "cid", "seq", F.lit(None).cast("string").alias("audit"), "role", "text").union(
        found.select("known", "cid", F.lit(-1).cast("long"), "audit", F.lit(None).cast("string"), F.lit(None).cast("string")))
    return both.repartition("known", "cid").sortWithinPartitions("known", "cid", "seq").mapInArrow(_write, TURNS)


DIGESTS = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("cid", T.LongType()), T.StructField("digest", T.StringType())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        key, h = None, None
        for batch in batches:
            for known, cid, role, text in zip(*(batch.column(c).to_pylist() for c in ("known", "cid", "role", "text"))):
                if (known, cid) != key:
                    if h:
                        yield *key, h.hexdigest()
                    key, h = (known, cid), hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
        if h:
            yield *key, h.hexdigest()

    return _chunks(rows(), DIGESTS, [pa.bool_(), pa.int64(), pa.string()])


def digests(repaired: DataFrame) -> DataFrame:
    """(known, cid, digest): SHA-256 of each conversation's ``role:text`` lines, from rows that lie together and in order. The texts stream by."""
    return repaired.mapInArrow(_digest, DIGESTS)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, summary). Turns: conv_id, place (from 0), edit (K, R or I), role, text. Summary, one row per conversation: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit.

    Rows (conv_id, turn, role, text) are taken by turn, nulls first, then by role and text. A null role or text is one space; a null conv_id is a
    conversation like any other; null turns leave no gaps. A row's first fault counts: blank (nothing but blanks), duplicate (role and text seen
    earlier in the conversation), truncated (its last character that is not a blank is none of ``.!?``). Blank and duplicate rows are always
    deleted. Of equally cheap repairs the one whose audit is least in ASCII is taken. Repeated rows are duplicates. Other columns are ignored. No
    rows give no rows. A conversation's audit is one value in memory, its texts are not.
    """
    turns = in_order(conversations)
    found = audits(faults(turns))
    shown = repaired_turns(turns, found).select(_conversation(turns).alias("conv_id"), "place", "edit", "role", "text")
    return shown, found.select(_conversation(found).alias("conv_id"), *[c for c in found.columns if c not in ("known", "cid")])
