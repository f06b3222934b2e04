"""Bars, orders, quotes and fills derived from the star-schema tables, so every query has data.

The tables hold no prices. A close is the running product of a daily move taken from the discounts of
the lines shipped that day plus a slow seasonal drift. Sums run over whole cents, so any engine gets the
same numbers.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barframe.plans.settle import settle

BENCHMARK = "MKT"
_written: dict[tuple[str, str, str], DataFrame] = {}
_lock = threading.Lock()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _walk(lines: DataFrame, k: float, a: float, phase: Column) -> DataFrame:
    """Daily (symbol, date) sums to an OHLCV walk; one row per date, so the window is calendar-bound."""
    day = (
        lines.groupBy("symbol", F.to_date("l_shipdate").alias("date"))
        .agg(
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("_disc"),
            F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("_tax"),
            F.count(F.lit(1)).alias("_rows"),
            F.sum(F.col("l_quantity").cast("long")).alias("_qty"),
        )
    )
    w = Window.partitionBy("symbol").orderBy("date")
    days = F.datediff("date", F.lit("1995-01-01").cast("date"))
    move = F.lit(k) * (F.col("_disc") / 100.0 / F.col("_rows") - 0.05) + F.lit(a) * F.sin(
        F.lit(2.0) * F.pi() * (days + phase) / 400.0
    )
    running = F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))
    spread = F.lit(0.01) * (F.col("_tax") / 100.0 / F.col("_rows"))
    d = day.withColumn("_r", move).withColumn("close", F.round(F.lit(100.0) * F.exp(running), 4))
    d = d.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    return d.select(
        "symbol",
        "date",
        "open",
        F.round(F.greatest("open", "close") * F.exp(spread), 4).alias("high"),
        F.round(F.least("open", "close") * F.exp(-spread), 4).alias("low"),
        "close",
        F.col("_qty").cast("double").alias("volume"),
    )


def derive_brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    number = F.regexp_extract("symbol", r"#(\d+)$", 1).cast("int")
    return _walk(lines, 0.4, 0.006, 37 * number)


def derive_market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("symbol", F.lit(BENCHMARK))
    return _walk(lines, 1.2, 0.004, F.lit(0))


def derive_supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("symbol", F.concat(F.lit("S"), F.col("l_suppkey")))
    return _walk(lines, 0.4, 0.006, (F.regexp_extract("symbol", r"S(\d+)$", 1).cast("int") * 37) % 400)


_RULES = {
    "brand": derive_brand_bars,
    "market": derive_market_bars,
    "supplier": derive_supplier_bars,
    "brand+market": lambda s, d: derive_brand_bars(s, d).unionByName(derive_market_bars(s, d)),
}


def bars(spark: SparkSession, sf_dir: str, kind: str = "brand") -> DataFrame:
    """Derived bars as a written table, one write per session, folder and kind."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    with _lock:
        if key not in _written:
            _written[key] = settle(_RULES[kind](spark, sf_dir), f"bars-{kind.replace('+', '-')}")
        return _written[key]


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of the part table as a universe."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as trade prices; the event type is the symbol and each event trades one unit."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("size"),
    )


def brand_of(key: Column) -> Column:
    return F.concat(F.lit("Brand#"), (F.pmod(key, F.lit(25)) + 1).cast("string"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as trade orders: one symbol, side, size and type per order."""
    o = table(spark, sf_dir, "orders")
    limit = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.round(80 + F.col("o_orderkey") % 41, 2))
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        brand_of(F.col("o_orderkey")).alias("symbol"),
        F.when(F.col("o_orderkey") % 3 == 0, "SELL").otherwise("BUY").alias("side"),
        F.round(F.col("o_totalprice") / 5000.0, 0).alias("qty"),
        F.when(limit.isNotNull(), "LIMIT").otherwise("MARKET").alias("order_type"),
        limit.cast("double").alias("limit_price"),
        F.when(F.col("o_orderstatus") == "O", "ACCEPTED")
        .when(F.col("o_orderstatus") == "P", "PARTIALLY_FILLED")
        .otherwise("FILLED")
        .alias("status"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest quote per symbol from its last bar."""
    last = bars(spark, sf_dir).groupBy("symbol").agg(
        F.max_by(F.struct("date", "close", "high", "low"), "date").alias("q")
    )
    return last.select(
        "symbol",
        F.col("q.date").alias("date"),
        F.round(F.col("q.close") * 0.999, 4).alias("bid"),
        F.round(F.col("q.close") * 1.001, 4).alias("ask"),
        F.col("q.close").alias("last"),
        F.col("q.high").alias("high"),
        F.col("q.low").alias("low"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fills, one per order and line number (the table repeats some line numbers)."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_shipdate", "l_quantity", "l_extendedprice", "l_tax", "l_suppkey")).alias("x")
    )
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("fill_id"),
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_orderkey") % 50).cast("long").alias("account_id"),
        F.col("x.l_shipdate").cast("timestamp").alias("ts"),
        brand_of(F.col("l_orderkey")).alias("symbol"),
        F.when(F.col("l_orderkey") % 3 == 0, "SELL").otherwise("BUY").alias("side"),
        F.col("x.l_quantity").alias("qty"),
        F.round(F.col("x.l_extendedprice") / F.col("x.l_quantity"), 8).alias("price"),
        F.round(F.col("x.l_tax") * 10, 2).alias("fee"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"), (F.col("c_acctbal") * 10).alias("cash")
    )


def forget() -> None:
    """Drop the written bars, so the next call derives them again."""
    with _lock:
        _written.clear()
