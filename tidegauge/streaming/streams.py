"""Structured Streaming forms of the monitoring, feature and loading operators.

Every sink is a folder of Parquet rows tagged with the micro-batch, written by ``foreachBatch``: a batch
that is run again after a failure overwrites its own folder, so results stay exactly once.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.ordering import attach
from tidegauge.operators.stats import bin_index
from tidegauge.session import scratch
from tidegauge.sources.tables import append_once


def file_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream the Parquet files of a folder under a known schema."""
    r = spark.readStream.schema(like.schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as TIMESTAMP (watermarks reject the zone-less type) with a watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def drain(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str) -> dict:
    """Process all available input, then stop; returns the rows dropped as too late."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()
    late = 0
    for p in q.recentProgress:
        late += sum(s.get("numRowsDroppedByWatermark", 0) for s in p["stateOperators"])
    return {"batches": len(q.recentProgress), "late_rows": late}


def _tagged_sink(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream to its end and read what it wrote, with the micro-batch number."""
    spark = stream.sparkSession
    root = scratch(spark, name)
    drain(stream, mode, _tagged_sink(f"{root}/rows"), f"{root}/checkpoint")
    return spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")


def newest(updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Final state of an update-mode sink: the row of the last micro-batch per key."""
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_l")).select(*keys, "_l.*")


def windowed_metrics(stream: DataFrame, ts: str, key: str, aggs: dict[str, Column], length: str, slide: str | None = None, start: str | None = None, delay: str = "1 day") -> DataFrame:
    """Metrics per (key, event-time window); tumbling without ``slide``."""
    s = with_event_time(stream, ts, delay)
    w = F.window(ts, length, slide or length, start)
    return s.groupBy(w.alias("window"), key).agg(*[c.alias(n) for n, c in aggs.items()]).select(key, F.col("window.start").alias("start"), *aggs)


def latest_values(stream: DataFrame, ts: str, key: str, order: list[str], columns: list[str], ttl: str, delay: str = "1 day") -> DataFrame:
    """Newest values per key and event-time span of ``ttl``, kept current (update mode), with the start of the span.

    A span leaves the state once the watermark has passed it, so the state holds the keys of the last ``ttl`` + ``delay``, not every
    key ever seen. Read the result with ``unexpired``.
    """
    s = with_event_time(stream, ts, delay)
    newest_of = F.max_by(F.struct(ts, *columns), F.struct(*order)).alias("_l")
    return s.groupBy(F.window(ts, ttl).alias("window"), key).agg(newest_of).select(key, F.col("window.start").alias("start"), "_l.*")


def unexpired(updates: DataFrame, ts: str, key: str, order: list[str], columns: list[str], ttl: str) -> DataFrame:
    """The value of each key as of the newest event read, if it is not older than ``ttl``."""
    spans = newest(updates, [key, "start"], [ts, *columns])
    last = spans.groupBy(key).agg(F.max_by(F.struct(ts, *columns), F.struct(*order)).alias("_l")).select(key, "_l.*")
    return attach(last, last.agg(F.max(ts).alias("now"))).where(F.col(ts) >= F.col("_s.now") - F.expr(f"interval {ttl}")).select(key, *columns)


def ingest_once(stream: DataFrame, ts: str, key: str, store: str, valid: Column, name: str, delay: str = "2 days") -> dict:
    """Idempotent ingest: repeats inside the watermark are dropped by state, older ones by the store's keys."""
    spark = stream.sparkSession
    columns = [c for c in stream.columns]
    s = with_event_time(stream, ts, delay).dropDuplicatesWithinWatermark([key])

    def load(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*columns).withColumn("seq", F.lit(0))
        append_once(rows, store, key, "seq", valid)

    return drain(s, "append", load, f"{scratch(spark, name)}/checkpoint")


def streamed_bins(stream: DataFrame, edges: DataFrame, ts: str, key: str, value: str, length: str, start: str, bins: int = 10, delay: str = "1 day") -> DataFrame:
    """Counts per (key, window, reference bin): the state a running stability index needs.

    ``edges``: one row per key with the array ``_edges`` (static side of the join).
    """
    s = with_event_time(stream, ts, delay).join(edges, key).withColumn("bin", bin_index(F.col(value), F.col("_edges")))
    w = F.window(ts, length, length, start)
    counts = [F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(bins)]
    return s.groupBy(w.alias("window"), key).agg(*counts).select(key, F.col("window.start").alias("start"), *[f"b{i}" for i in range(bins)])


def psi_of_counts(current: Column, reference: Column, eps: float = 1e-4) -> Column:
    """Stability index of two count arrays."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    share = lambda c: F.transform(c, lambda x: F.greatest(x / total(c), F.lit(eps)))
    t = F.zip_with(share(current), share(reference), lambda p, q: (p - q) * F.log(p / q))
    return F.aggregate(t, F.lit(0.0), lambda s, x: s + x)
