"""Newest value per key with a time to live: keyed state and event-time timers."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.operators.ordering import attach
from tidegauge.streaming.streams import with_event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """The state store that keyed state with timers needs, for streams started inside the block; the session's own setting comes back after it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class NewestUntil(StatefulProcessor):
    """Holds a key's newest row and one timer at its time plus ``ttl_ms``; the timer clears the state and reports the end."""

    def __init__(self, key: str, order: list[str], columns: list[str], kinds: str, ttl_ms: int):
        self.key, self.order, self.columns, self.kinds, self.ttl_ms = key, order, columns, kinds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("newest", f"at long, {self.kinds}")

    def _rank(self, row: dict) -> tuple:
        return tuple(row[c] for c in self.order)

    def _row(self, key, at: int, values, live: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key], "at": [at], "live": [live], **{c: pd.Series([v], dtype="object") for c, v in zip(self.columns, values)}})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.held.get() if self.held.exists() else None
        best = dict(zip(["at", *self.columns], old)) if old else None
        for b in rows:  # batches of the key's new rows; only the newest is kept
            top = b.sort_values(self.order).iloc[-1]
            row = {c: None if pd.isna(top[c]) else getattr(top[c], "item", lambda v=top[c]: v)() for c in ["at", *self.columns]}
            if best is None or self._rank(row) > self._rank(best):
                best = row
        values = tuple(best[c] for c in self.columns)
        if old is None or (best["at"], *values) != tuple(old):
            if old is not None:
                self.handle.deleteTimer(self._ends(old[0]))
            self.held.update((best["at"], *values))
            self.handle.registerTimer(self._ends(best["at"]))
            yield self._row(key[0], best["at"], values, True)

    def _ends(self, at: int) -> int:
        return -(-at // 1_000) + self.ttl_ms  # timers are in milliseconds

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.held.get()[0]
        self.held.clear()
        yield self._row(key[0], at + self.ttl_ms * 1_000, [None] * len(self.columns), False)

    def close(self) -> None:
        pass


def expiring_values(stream: DataFrame, ts: str, key: str, order: list[str], columns: list[str], ttl_seconds: int, delay: str = "1 day") -> DataFrame:
    """Changes of the newest value of each key, in update mode: (key, at, live, columns...), ``at`` in microseconds.

    A value is reported when it replaces an older one (``order`` names ``ts`` or columns; nulls in them are not expected), and once more,
    with ``live`` false and null columns, when the watermark passes its time plus the time to live without a newer one: any key's events move the
    watermark. The state then holds nothing for the key, so it is as large as the keys of the last ``ttl_seconds`` plus ``delay``. Rows behind the
    watermark are dropped by Spark; rows with a null key or time take no part. Start the stream inside ``rocks_state``.
    """
    s = with_event_time(stream, ts, delay).where(F.col(ts).isNotNull() & F.col(key).isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    rows = s.select(ts, key, F.unix_micros(ts).alias("at"), *[c for c in columns if c not in (ts, key)])
    newest = NewestUntil(key, ["at" if c == ts else c for c in order], list(columns), fields, ttl_seconds * 1_000)
    return rows.groupBy(key).transformWithStateInPandas(newest, f"`{key}` {kinds[key]}, at long, live boolean, {fields}", "Update", "EventTime")


def current_values(updates: DataFrame, key: str, columns: list[str], ttl_seconds: int) -> DataFrame:
    """What is served after the last change: the last report of each key, if it is live and not older than the time to live at the newest event.

    Timers follow the watermark, which trails the newest event by its delay; the age is therefore checked again here.
    """
    last = updates.groupBy(key).agg(F.max_by(F.struct("at", "live", *columns), F.struct("batch", "at")).alias("_l")).select(key, "_l.*")
    now = updates.where("live").agg(F.max("at").alias("now"))
    return attach(last.where("live"), now).where(F.col("at") >= F.col("_s.now") - ttl_seconds * 1_000_000).select(key, *columns)
