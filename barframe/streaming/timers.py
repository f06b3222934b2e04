"""Operators on streams that wait for a time: whole cross-sections of finished dates, and alarms for silent feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barframe.operators.xsection import xs_rank, xs_zscore
from barframe.streaming.state import require_rocksdb

DAY_MS = 86_400_000
BUCKETS = 16


class DateProcessor(StatefulProcessor):
    """Holds the rows of one date and bucket; an event-time timer at the end of the date lets them go.

    Rows that come after that are late and left out. Of rows with one symbol the one with the larger values counts.
    """

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = T.StructType([T.StructField("symbol", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in self.columns]])
        self.rows = handle.getListState("rows", kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = (int(key[0]) + 1) * DAY_MS
        if timerValues.getCurrentWatermarkInMs() < end:
            for pdf in rows:
                values = pdf[["symbol", *self.columns]].astype(object)
                self.rows.appendList([tuple(r) for r in values.where(values.notna(), None).to_numpy()])
            self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pdf = pd.DataFrame(list(self.rows.get()), columns=["symbol", *self.columns]).dropna(subset=["symbol"])
        self.rows.clear()
        pdf = pdf.sort_values(["symbol", *reversed(self.columns)], na_position="first").drop_duplicates("symbol", keep="last")
        pdf.insert(0, "at", int(key[0]))
        if len(pdf):
            yield pdf.astype({c: "float64" for c in self.columns})

    def close(self) -> None:
        pass


def complete_dates(bars: DataFrame, columns: list[str], watermark: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """(symbol, date, columns) of every date once the watermark has passed it, all rows of a date in one micro-batch.

    State is keyed by date and bucket of symbols, so a wide cross-section is not one key. Needs the RocksDB state store.
    """
    require_rocksdb(bars.sparkSession)
    d = bars.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", watermark)
    d = d.select("ts", "symbol", *[F.col(c).cast("double").alias(c) for c in columns], F.unix_date("date").cast("long").alias("at"), F.pmod(F.xxhash64("symbol"), F.lit(buckets)).alias("bucket"))
    out = T.StructType([T.StructField("at", T.LongType()), T.StructField("symbol", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in columns]])
    held = d.groupBy("at", "bucket").transformWithStateInPandas(statefulProcessor=DateProcessor(columns), outputStructType=out, outputMode="append", timeMode="eventTime")
    return held.select("symbol", F.expr("date_from_unix_date(cast(at as int))").alias("date"), *columns)


def stream_cross_section(bars: DataFrame, out: str, checkpoint: str, columns: list[str], watermark: str = "1 day", once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Write every finished date's rows with their ``{column}_z`` and ``{column}_rank`` to ``{out}/batch=...``.

    The scores are those of the batch job (:func:`xs_zscore`, :func:`xs_rank`) on whole dates. A repeated micro-batch writes the same folder.
    """

    def handle(batch: DataFrame, number: int) -> None:
        d = xs_zscore(batch.persist(), columns)
        for c in columns:
            d = xs_rank(d, c, out=f"{c}_rank")
        d.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    writer = complete_dates(bars, columns, watermark, buckets).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


_LAST = T.StructType([T.StructField("last", T.LongType()), T.StructField("timer", T.LongType()), T.StructField("stale", T.BooleanType())])
_ALARM = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("last", T.LongType()), T.StructField("stale", T.BooleanType())])


class SilenceProcessor(StatefulProcessor):
    """Keeps the last event time of a key and a timer for when the limit runs out without another one.

    With the event clock a gap is the distance of two event times, however they are cut into batches; with the wall clock it is the time
    since the last event arrived. An alarm names the last event; on the wall clock ``stale`` false reports the first event after one.
    """

    def __init__(self, limit_ms: int, wall: bool) -> None:
        self.limit, self.wall = limit_ms, wall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _LAST)

    def _alarms(self, key, rows: list[tuple[int, bool]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], at, stale) for at, stale in rows], columns=_ALARM.fieldNames())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        times = sorted({int(t) for pdf in rows for t in pdf["us"]})
        last, timer, stale = self.kept.get() if self.kept.exists() else (None, None, False)
        found = []
        if last is not None:
            times = [t for t in times if t > last]
            if not times:
                return
            if self.wall and stale:
                found.append((times[0], False))
            elif not self.wall and not stale and times[0] - last > self.limit * 1000:
                found.append((last, True))
            if timer is not None:
                self.handle.deleteTimer(timer)
        if not self.wall:
            found += [(a, True) for a, b in zip(times, times[1:]) if b - a > self.limit * 1000]
        # The event clock has passed the limit when the watermark is beyond the last event by more than it.
        end = timerValues.getCurrentProcessingTimeInMs() + self.limit if self.wall else times[-1] // 1000 + self.limit + 1
        self.handle.registerTimer(end)
        self.kept.update((times[-1], end, False))
        if found:
            yield self._alarms(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, stale = self.kept.get()
        self.kept.update((last, None, True))
        if not stale:
            yield self._alarms(key, [(last, True)])

    def close(self) -> None:
        pass


def stream_silence(events: DataFrame, limit_seconds: float = 5.0, clock: str = "event", watermark: str = "0 seconds", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """(symbol, last_ts, stale): an alarm when a key is silent for longer than the limit, without any new event of it.

    ``clock`` is ``event`` (event times and the watermark: the same alarms on every run) or ``wall`` (processing time, for live feeds; Spark then looks at the
    timers at every trigger). Rows without a key only move the watermark. Needs the RocksDB state store.
    """
    if clock not in ("event", "wall"):
        raise ValueError(f"clock must be 'event' or 'wall', got {clock}")
    require_rocksdb(events.sparkSession)
    d = events.select(F.col(by).alias("symbol"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts)).alias("us"))
    wall = clock == "wall"
    d = d if wall else d.withWatermark("ts", watermark)
    alarms = d.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=SilenceProcessor(int(limit_seconds * 1000), wall), outputStructType=_ALARM, outputMode="append", timeMode="processingTime" if wall else "eventTime")
    return alarms.select("symbol", F.timestamp_micros("last").alias("last_ts"), "stale")
