"""Ticker lists and the symbols a bar table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_tickers(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed, upper-cased, non-blank symbols."""
    symbol = F.upper(F.trim(F.col(column)))
    return lines.select(symbol.alias("symbol")).filter(F.col("symbol") != "")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return parse_tickers(spark.read.text(path))


def list_symbols(bars: DataFrame | None, tickers: DataFrame | None = None) -> DataFrame:
    """Symbols of the ticker list when there is one, else the sorted symbols of the bar table."""
    if tickers is not None:
        return tickers.select("symbol")
    if bars is None:
        raise ValueError("list_symbols needs bars or tickers")
    return bars.select("symbol").distinct().orderBy("symbol")


def split_benchmark(bars: DataFrame, benchmark: str, universe: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(trading bars, benchmark bars); the benchmark is kept even when the universe leaves it out."""
    bench = bars.filter(F.col("symbol") == benchmark)
    if universe is None:
        return bars.filter(F.col("symbol") != benchmark), bench
    return bars.join(universe.select("symbol").distinct(), "symbol", "left_semi"), bench
