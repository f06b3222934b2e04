"""What bars are held per symbol, how old they are and what to fetch next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _weekdays_until(day: Column) -> Column:
    """Weekdays from Monday 1970-01-05 up to and including ``day``."""
    k = F.datediff(day, F.lit("1970-01-05").cast("date")) + 1
    return (F.floor(k / 7) * 5 + F.least(F.pmod(k, F.lit(7)), F.lit(5))).cast("long")


def business_days_after(last: Column, today: Column) -> Column:
    """Weekdays after ``last`` up to and including ``today``; 0 when ``last`` is not earlier."""
    return F.greatest(_weekdays_until(today) - _weekdays_until(last), F.lit(0).cast("long"))


def inventory(bars: DataFrame, universe: DataFrame, today, formats: DataFrame | None = None) -> DataFrame:
    """Rows, first and last date and staleness of every universe symbol.

    ``formats`` (symbol, has_csv, has_parquet) tells which files exist; without it, held means Parquet.
    """
    held = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    d = universe.select("symbol").distinct().join(held, "symbol", "left")
    if formats is not None:
        d = d.join(formats.select("symbol", "has_csv", "has_parquet"), "symbol", "left")
    else:
        d = d.withColumns({"has_csv": F.lit(False), "has_parquet": F.col("n_rows").isNotNull()})
    stale = business_days_after(F.col("last_date"), F.lit(str(today)).cast("date"))
    return d.select(
        "symbol",
        F.coalesce("has_csv", F.lit(False)).alias("has_csv"),
        F.coalesce("has_parquet", F.lit(False)).alias("has_parquet"),
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        "first_date",
        "last_date",
        F.coalesce(F.when(F.col("last_date").isNotNull(), stale), F.lit(0)).cast("long").alias("days_stale"),
    ).withColumns(
        {"present": F.col("has_csv") | F.col("has_parquet"), "is_stale": F.col("days_stale") > 1}
    )


def missing(inv: DataFrame) -> DataFrame:
    return inv.filter(~F.col("present")).select("symbol")


def present(inv: DataFrame) -> DataFrame:
    return inv.filter(F.col("present")).select("symbol")


def stale(inv: DataFrame, max_days: int = 1) -> DataFrame:
    return inv.filter(F.col("days_stale") > max_days).select("symbol")


def status(inv: DataFrame) -> DataFrame:
    """Counts of present, missing and stale symbols in one row."""
    return inv.agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.count_if(F.col("present")).alias("present"),
        F.count_if(~F.col("present")).alias("missing"),
        F.count_if(F.col("is_stale")).alias("stale"),
    )


def status_table(inv: DataFrame) -> DataFrame:
    """One printable line per symbol."""
    state = F.when(~F.col("present"), "MISSING").when(F.col("is_stale"), "STALE").otherwise("ok")
    dash = F.lit("-")
    return inv.select(
        "symbol",
        state.alias("status"),
        "n_rows",
        F.coalesce(F.date_format("first_date", "yyyy-MM-dd"), dash).alias("first"),
        F.coalesce(F.date_format("last_date", "yyyy-MM-dd"), dash).alias("last"),
        F.when(F.col("days_stale") > 0, F.concat(F.col("days_stale").cast("string"), F.lit("d"))).otherwise("-").alias("age"),
    )


def sync_plan(inv: DataFrame, today, force: bool = False, start: str = "1970-01-01") -> DataFrame:
    """What to fetch per symbol: skip, update from the day after the last bar, or new from ``start``."""
    end = F.lit(str(today)).cast("date")
    fresh = F.lit(not force) & F.col("present") & ~F.col("is_stale")
    known = F.col("present") & F.col("last_date").isNotNull()
    begin = F.when(known, F.date_add("last_date", 1)).otherwise(F.lit(start).cast("date"))
    skip = fresh | (begin > end)
    action = F.when(skip, "skip").when(known, "update").otherwise("new")
    return inv.select(
        "symbol", action.alias("action"), F.when(~skip, begin).alias("start"), F.when(~skip, end).alias("end")
    )


def sync_report(results: DataFrame, column: str = "action") -> DataFrame:
    return results.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
