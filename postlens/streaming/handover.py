"""A lifecycle stream that starts where a batch left off."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import scratch_path
from .events import MISSED_DAYS, SIGHTING_SCHEMA, STATE_SCHEMA, event_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lifecycle_batch(sightings: DataFrame, delay: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(events, state) of a table of (job_id, observed_at): what a stream over it has emitted, and what it holds at its end.

    state has job_id, last_seen and open.  A posting not seen for a whole day up to the latest
    sighting less ``delay`` has disappeared.
    """
    timed = sightings.select("job_id", F.col("observed_at").cast("timestamp").alias("observed_at"))
    days = timed.groupBy("job_id", F.to_date("observed_at").alias("day")).agg(F.min("observed_at").alias("low"), F.max("observed_at").alias("high"))
    run = Window.partitionBy("job_id").orderBy("day")
    steps = days.withColumns({"_before": F.lag("high").over(run), "_gap": F.datediff("day", F.lag("day").over(run)), "_last": F.lead("day").over(run).isNull()})
    mark = timed.agg((F.max("observed_at") - F.expr(f"INTERVAL {delay}")).alias("m"))
    steps = steps.withColumn("_gone", F.col("_last") & (F.date_add("day", MISSED_DAYS).cast("timestamp") <= mark.scalar()))
    back = F.col("_gap") >= MISSED_DAYS
    event = lambda when, kind, at, gap: F.when(when, F.struct(F.lit(kind).alias("event_type"), F.col(at).alias("observed_at"), gap.cast("int").alias("gap_days")))
    none = F.lit(None)
    made = F.array_compact(F.array(event(F.col("_gap").isNull(), "appeared", "low", none), event(back, "disappeared", "_before", none), event(back, "reappeared", "low", F.col("_gap")), event(F.col("_gone"), "disappeared", "high", none)))
    events = steps.select("job_id", F.explode(made).alias("e")).select("job_id", "e.*")
    return events, steps.filter("_last").select("job_id", F.col("high").alias("last_seen"), (~F.col("_gone")).alias("open"))


class Lifecycle(StatefulProcessor):
    """Appeared, disappeared and reappeared of one posting; its state is the last sighting and whether it is open.

    A timer two days after the last sighting's date closes a posting; one at the end of the
    retention forgets it.
    """

    def __init__(self, retention_days: int):
        self.retention_days = retention_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("posting", STATE_SCHEMA)

    def _keep(self, last: pd.Timestamp, is_open: bool, days: int, now: int) -> None:
        self.state.update((last.to_pydatetime(), is_open))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(max(int((last.normalize() + pd.Timedelta(days=days)).timestamp() * 1000), now + 1))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        is_open = bool(row["open"])
        self._keep(pd.Timestamp(row["last_seen"]), is_open, MISSED_DAYS if is_open else MISSED_DAYS + self.retention_days, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        last, is_open = (pd.Timestamp(held[0]), held[1]) if held else (None, False)
        days: dict = {}
        for batch in rows:
            for day, span in batch["observed_at"].groupby(batch["observed_at"].dt.normalize()).agg(["min", "max"]).iterrows():
                low, high = days.get(day, (span["min"], span["max"]))
                days[day] = (min(low, span["min"]), max(high, span["max"]))
        out: list[tuple] = []
        for day in sorted(days):
            low, high = days[day]
            gap = None if last is None else (day - last.normalize()).days
            if last is None:
                out.append((key[0], "appeared", low, None))
            elif gap >= MISSED_DAYS:
                if is_open:
                    out.append((key[0], "disappeared", last, None))
                out.append((key[0], "reappeared", low, gap))
            last, is_open = (high if last is None else max(last, high)), True
        if days:
            self._keep(last, True, MISSED_DAYS, timerValues.getCurrentWatermarkInMs())
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held is None:
            yield self._frame([])
        elif held[1]:
            last = pd.Timestamp(held[0])
            self._keep(last, False, MISSED_DAYS + self.retention_days, timerValues.getCurrentWatermarkInMs())
            yield self._frame([(key[0], "disappeared", last, None)])
        else:  # gone for the whole retention: forgotten, and new if it comes again
            self.state.clear()
            yield self._frame([])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["job_id", "event_type", "observed_at", "gap_days"]).astype({"gap_days": "Int32", "observed_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def continue_lifecycle(sightings: DataFrame, state: DataFrame, delay: str = "1 hour", retention_days: int = 365) -> DataFrame:
    """Lifecycle events of a stream of (job_id, observed_at) whose postings begin in ``state`` (see ``lifecycle_batch``)."""
    timed = sightings.select("job_id", F.col("observed_at").cast("timestamp").alias("observed_at")).withWatermark("observed_at", delay)
    return timed.groupBy("job_id").transformWithStateInPandas(Lifecycle(retention_days), SIGHTING_SCHEMA, "append", "EventTime", state.select("job_id", "last_seen", "open").groupBy("job_id"))


def hand_over(before: DataFrame, after: DataFrame, name: str = "hand-over", **options) -> DataFrame:
    """Events of a batch over ``before`` and of a stream over ``after`` that goes on from it."""
    spark = before.sparkSession
    base = scratch_path(spark, name)
    events, state = lifecycle_batch(before)
    state.write.parquet(f"{base}/state-table")
    after.write.parquet(f"{base}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = continue_lifecycle(event_stream(spark, f"{base}/in", after.schema), spark.read.parquet(f"{base}/state-table"), **options)
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return events.unionByName(spark.read.schema(SIGHTING_SCHEMA).parquet(f"{base}/rows"))
