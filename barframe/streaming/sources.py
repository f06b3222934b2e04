"""Streams of bars and ticks, time-window bars, duplicate removal, feed age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.schema import BARS
from barframe.sources.resample import resample


def stream_bars(spark: SparkSession, path: str, schema: T.StructType = BARS, files_per_trigger: int = 1) -> DataFrame:
    """Bars arriving as Parquet files, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_resample(
    ticks: DataFrame, every: str, watermark: str, slide: str | None = None, tie: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Time-window bars; a window is final once the watermark has passed its end."""
    return resample(ticks.withWatermark(ts, watermark), every, slide, ts=ts, tie=tie)


def closing_row(rows: DataFrame, schema: T.StructType, time: str, after: str) -> DataFrame:
    """The row that ends a finished feed: only its time is set, ``after`` the last one, so the watermark passes all windows.

    Write it behind the feed's last file. The window that holds it stays open and is never emitted.
    """
    end = rows.agg((F.max(time).cast("timestamp") + F.expr(f"interval {after}")).alias("_end"))
    return end.select(*[(F.col("_end") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def stream_dedupe(events: DataFrame, keys: list[str], watermark: str, ts: str = "ts") -> DataFrame:
    """First event per key; a key is remembered for the watermark's delay, so state stays bounded."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def stream_date_stats(bars: DataFrame, watermark: str = "1 day", column: str = "close") -> DataFrame:
    """One row per finished trading date: symbols, mean and deviation of ``column``.

    A date is emitted when the watermark passes it, which is when its cross-section is complete.
    """
    d = bars.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", watermark)
    return (
        d.groupBy(F.window("ts", "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n_symbols"),
            F.avg(column).alias("mean"),
            F.stddev_pop(column).alias("sd"),
        )
        .select(F.to_date("w.start").alias("date"), "n_symbols", "mean", "sd")
    )


def feed_age(events: DataFrame, now, limit_seconds: float = 5.0, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Seconds since the last event of each key and whether that is longer than the limit."""
    last = events.groupBy(by).agg(F.max(ts).alias("last_ts"))
    age = F.unix_micros(F.lit(str(now)).cast("timestamp")) - F.unix_micros("last_ts")
    return last.withColumn("age_seconds", age / 1e6).withColumn("stale", F.col("age_seconds") > limit_seconds)
