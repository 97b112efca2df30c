"""Event log as a stream: windowed counts and per-posting lifecycle state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import dedupe_best
from ..session import scratch_path


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_counts(stream: DataFrame, window: str = "1 day", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts per window and type; repeats of an event id and late rows are dropped.

    State holds the ids and windows inside the watermark only.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window(ts, window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")


def batch_event_counts(events: DataFrame, window: str = "1 day", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """What :func:`event_counts` emits for a table whose rows come in time: an event id counts once, at its earliest.

    Which rows are late depends on when they arrive, and that a table does not say.
    """
    timed = dedupe_best(events.withColumn(ts, F.col(ts).cast("timestamp")), ["event_id"], [F.col(ts)])
    mark = timed.agg((F.max(ts) - F.expr(f"INTERVAL {delay}")).alias("m"))
    counts = timed.groupBy(F.window(ts, window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")
    return counts.withColumn("_m", mark.scalar()).filter(F.col("window_end") <= F.col("_m")).drop("_m")


def session_counts(stream: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Visits of a key: events no further apart than ``gap``; one row when the watermark passes a visit's end."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_arrivals(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, int]:
    """(rows emitted, rows dropped as late) of a stream that finds one part after the other.

    Each part is written to the stream's folder and drained before the next arrives, however
    many files it has, so a row is late by the watermark of the parts before its own.
    """
    spark = parts[0].sparkSession
    base = scratch_path(spark, name)
    dropped = 0
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        out = make(event_stream(spark, f"{base}/in", parts[0].schema))
        query = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows")
        query.awaitTermination()
        dropped += sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])
    return spark.read.schema(out.schema).parquet(f"{base}/rows"), dropped


SIGHTING_SCHEMA = "job_id string, event_type string, observed_at timestamp, gap_days int"
STATE_SCHEMA = "last_seen timestamp, open boolean"


MISSED_DAYS = 2  # fixed value: two dates apart means a whole day without a sighting


def _follow(key, rows: Iterator[pd.DataFrame], state, retention_days: int) -> Iterator[pd.DataFrame]:
    """Turn sightings of one posting into appeared / disappeared / reappeared.

    Sightings are folded to first and last time per day as batches arrive, so a
    busy posting costs one entry per day, and the outcome does not depend on how
    the stream was cut into batches.
    """
    last, is_open = state.get if state.exists else (None, False)
    last = None if last is None else pd.Timestamp(last)
    out: list[tuple] = []
    if state.hasTimedOut:
        if not is_open:  # gone for the whole retention: forgotten, and new if it comes again
            state.remove()
            return
        state.update((last, False))
        forget = int((last.normalize() + pd.Timedelta(days=MISSED_DAYS + retention_days)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(forget, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "event_type": ["disappeared"], "observed_at": [last], "gap_days": [None]}).astype({"gap_days": "Int32"})
        return
    days: dict = {}
    for batch in rows:
        for day, span in batch["observed_at"].groupby(batch["observed_at"].dt.normalize()).agg(["min", "max"]).iterrows():
            low, high = days.get(day, (span["min"], span["max"]))
            days[day] = (min(low, span["min"]), max(high, span["max"]))
    for day in sorted(days):
        low, high = days[day]
        gap = None if last is None else (day - last.normalize()).days
        if last is None:
            out.append((key[0], "appeared", low, None))
        elif not is_open or gap >= MISSED_DAYS:
            if is_open:
                out.append((key[0], "disappeared", last, None))
            if gap >= MISSED_DAYS:
                out.append((key[0], "reappeared", low, gap))
        last, is_open = (high if last is None else max(last, high)), True
    if not days:
        return
    state.update((last, is_open))
    due = int((last.normalize() + pd.Timedelta(days=MISSED_DAYS)).timestamp() * 1000)
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=["job_id", "event_type", "observed_at", "gap_days"]).astype({"gap_days": "Int32"})


def lifecycle_stream(sightings: DataFrame, delay: str = "1 hour", retention_days: int = 365) -> DataFrame:
    """Lifecycle events from a stream of (job_id, observed_at).

    One small state per posting, kept for ``retention_days`` after it vanished.
    """

    def follow(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        return _follow(key, rows, state, retention_days)

    timed = sightings.select("job_id", F.col("observed_at").cast("timestamp").alias("observed_at")).withWatermark("observed_at", delay)
    return timed.groupBy("job_id").applyInPandasWithState(follow, SIGHTING_SCHEMA, STATE_SCHEMA, "append", "EventTimeTimeout")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drain what is available into a table in the shared folder and read it back."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
