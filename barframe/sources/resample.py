"""Ticks to OHLCV bars over time windows; the same plan runs on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample(
    ticks: DataFrame,
    every: str,
    slide: str | None = None,
    by: str = "symbol",
    ts: str = "ts",
    price: str = "price",
    size: str = "size",
    tie: str | None = None,
) -> DataFrame:
    """Open/high/low/close/volume/trades per ``by`` and window of length ``every``.

    First and last price are ``min_by``/``max_by`` on (ts, tie): all five aggregates combine before the
    shuffle, so a symbol with most of the ticks costs no more per task than any other.
    """
    order = F.struct(ts, tie) if tie else F.col(ts)
    window = F.window(F.col(ts), every, slide) if slide else F.window(F.col(ts), every)
    return (
        ticks.groupBy(F.col(by).alias("symbol"), window.alias("w"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum(size).alias("volume"),
            F.count(F.lit(1)).alias("trades"),
        )
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                "open", "high", "low", "close", "volume", "trades")
    )
