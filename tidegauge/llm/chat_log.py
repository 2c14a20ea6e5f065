"""Chat formatting from an event log: fold streamed deltas, edits and regenerations into final messages, then render.

Events (conv_id, seq, message, role, kind, payload), in the order of ``seq`` inside a conversation:

- ``delta``: the payload is added to the message's text;
- ``edit``: the payload replaces the text so far (null: withdraws nothing, an empty text);
- ``regenerate``: the text so far is thrown away;
- ``role``: sets the role of a message that has no delta yet (any event may carry a role; the last one named holds).

The fold needs no state machine: a message's text is everything after its last edit or regeneration, begun by that edit's payload.
All of it is Spark SQL expressions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: ``<|turn|>role\ntext<|end|>\n`` for each turn. No other ``<`` occurs: texts and roles are escaped.
TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings of common chat formats begin with one of these; each is replaced, ``&`` first, and put back in reverse.
ESCAPES = {"&": "&amp;", "<": "&lt;", "[": "&lsqb;"}
BREAK = {"\n": "&NewLine;"}  # in roles only: the first line break of a turn ends the role


def escape(c: Column, more: dict[str, str] | None = None) -> Column:
    for raw, safe in {**ESCAPES, **(more or {})}.items():
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, more: dict[str, str] | None = None) -> Column:
    for raw, safe in reversed({**ESCAPES, **(more or {})}.items()):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, first_seq, role, text): final messages. A message without text left is an empty one, not dropped.

    Events delivered twice (same conversation, message, seq, kind and payload) count once; different events of one seq are taken in
    the order of kind and payload. Null payloads are empty, null roles name nothing; a null conv_id or message is a
    value like any other; null seq comes first. Events of unknown kinds change nothing.
    """
    reset = F.col("kind").isin("edit", "regenerate")
    item = F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload"))
    grouped = events.groupBy("conv_id", "message").agg(
        F.array_sort(F.array_distinct(F.collect_list(item))).alias("log"),
        F.max(F.when(reset, F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload")))).alias("last"),
        F.min("seq").alias("first_seq"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
    )
    after = F.filter("log", lambda x: F.col("last").isNull() | (x > F.col("last")))
    # the last reset is an edit (its payload begins the text) or a regeneration
    begun = F.when(F.col("last.kind") == "edit", F.col("last.payload")).otherwise("")
    deltas = F.transform(F.filter(after, lambda x: x["kind"] == "delta"), lambda x: x["payload"])
    return grouped.select("conv_id", "message", "first_seq", "role", F.concat(begun, F.array_join(deltas, "")).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one string a conversation, and its loss mask as code-point ranges ``[from, to)`` of assistant texts.

    ``messages`` has conv_id, message, first_seq, role, text; turns are in the order of (first_seq, message). Texts are escaped reversibly, so
    nothing a user wrote can end a turn or begin one. Null roles are empty ones. A conversation is one row, so its messages
    meet in one task: the size of a conversation bounds the size of its row.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role, BREAK), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    before = Window.partitionBy("conv_id").orderBy("first_seq", "message").rowsBetween(Window.unboundedPreceding, -1)
    placed = messages.select("conv_id", "first_seq", "message", (role == "assistant").alias("own"), F.concat(head, body, F.lit(END)).alias("turn"), F.length(head).alias("a"), F.length(body).alias("n"))
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("a")
    part = F.struct("first_seq", "message", "turn", "own", F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to"))
    turns = placed.withColumn("start", start).groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda x: x["own"]), lambda x: F.struct(x["from"], x["to"]))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, as array<struct<role, text>>: the inverse of ``render``."""
    parts = F.slice(F.split(formatted, END.replace("|", r"\|")), 1, F.size(F.split(formatted, END.replace("|", r"\|"))) - 1)
    body = lambda x: F.substr(x, F.lit(len(TURN) + 1))
    role = lambda x: F.substring_index(body(x), "\n", 1)
    return F.transform(parts, lambda x: F.struct(unescape(role(x), BREAK).alias("role"), unescape(F.substr(body(x), F.length(role(x)) + 2)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda r: unescape(F.substr(formatted, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), "")


def format_log(events: DataFrame) -> DataFrame:
    return render(fold(events))
