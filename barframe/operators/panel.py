"""Trading calendar, the date x symbol panel with carried state, readiness and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.scalar import clean
from barframe.plans.settle import settle


def calendar(bars: DataFrame) -> DataFrame:
    """Sorted union of all trading dates: one row per date with its number and the next date."""
    w = Window.orderBy("date")  # one row per calendar day, however many symbols there are
    return (
        bars.select("date").distinct()
        .withColumn("idx", F.row_number().over(w).cast("long"))
        .withColumn("next_trading_date", F.lead("date").over(w))
    )


def panel(feats: DataFrame, cal: DataFrame, names: list[str], start=None, end=None) -> DataFrame:
    """Every (trading date, symbol) with the symbol's state as of its last bar.

    A bar stands for the dates from its own to the day before the symbol's next bar, so the whole row is
    carried (a NULL feature stays NULL) by expanding each bar over that span: no grid join, no second
    shuffle. Before a symbol's first bar its features are NULL. ``fresh`` marks dates with a bar.
    """
    lo, hi = cal.agg(F.min("date"), F.max("date")).first()
    lo = lo if start is None else max(lo, _date(start))
    hi = hi if end is None else min(hi, _date(end))
    first = F.when(F.col("n") == 1, F.least(F.lit(lo), F.col("date"))).otherwise(F.col("date"))
    first = F.greatest(first, F.lit(lo))
    last = F.least(F.coalesce(F.date_sub("next_date", 1), F.lit(hi)), F.lit(hi))
    spans = feats.withColumn("_from", first).withColumn("_to", last).filter(F.col("_from") <= F.col("_to"))
    days = spans.withColumn("_day", F.explode(F.sequence("_from", "_to")))
    known = F.col("_day") >= F.col("date")
    cols = [F.when(known, F.col(c)).alias(c) for c in names]
    out = days.select(
        F.col("_day").alias("date"),
        "symbol",
        F.when(known, F.col("n")).otherwise(F.lit(0)).alias("n"),
        (F.col("_day") == F.col("date")).alias("fresh"),
        *cols,
    )
    return out.join(cal.select("date"), "date", "left_semi")


def _date(x):
    import datetime as dt

    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)[:10])


def ready_date(feats: DataFrame, warmup: int = 200, threshold: float = 0.80) -> DataFrame:
    """First date on which at least ``threshold`` of the symbols have ``warmup`` bars (one row).

    Only the first and the ``warmup``-th bar of a symbol matter; they are counted per date.
    """
    events = feats.filter((F.col("n") == 1) | (F.col("n") == warmup)).groupBy("date").agg(
        F.count_if(F.col("n") == 1).alias("born"), F.count_if(F.col("n") == warmup).alias("warm")
    )
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    whole = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = events.select(
        "date", F.sum("warm").over(w).alias("n_warm"), F.sum("born").over(whole).alias("n_symbols")
    )
    hit = d.filter((F.col("n_warm") > 0) & (F.col("n_warm") >= F.col("n_symbols") * F.lit(threshold)))
    return hit.agg(F.min("date").alias("ready_date"))


def bars_received(feats: DataFrame) -> DataFrame:
    return feats.groupBy("symbol").agg(F.max("n").alias("bars"))


def snapshot(pan: DataFrame, asof, universe: DataFrame | None = None) -> DataFrame:
    """Cross-section on one date, optionally for a sub-universe."""
    out = pan.filter(F.col("date") == F.lit(str(asof)).cast("date"))
    if universe is not None:
        out = out.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    return out


def emit_dates(cal: DataFrame, ready, every: int = 1) -> DataFrame:
    """Every ``every``-th trading date from the ready date on."""
    if every < 1:
        raise ValueError(f"every must be >= 1, got {every}")
    live = cal.filter(F.col("date") >= F.lit(str(ready)).cast("date"))
    k = F.row_number().over(Window.orderBy("date"))
    return live.withColumn("_k", k).filter(F.col("_k") % every == 0).select("date")


def emit_every(pan: DataFrame, cal: DataFrame, ready, every: int = 1) -> DataFrame:
    return pan.join(emit_dates(cal, ready, every), "date", "left_semi")


def latest(pan: DataFrame, cal: DataFrame) -> DataFrame:
    """Cross-section on the last trading date."""
    last = cal.agg(F.max("date")).first()[0]
    return pan.filter(F.col("date") == F.lit(last))


def get(pan: DataFrame, symbol: str, feature: str) -> DataFrame:
    """One feature of one symbol over the dates."""
    return pan.filter(F.col("symbol") == symbol).select("date", F.col(feature).alias("value"))


def valid_ratio(pan: DataFrame, names: list[str]) -> DataFrame:
    """Share of symbols with a value, per date and feature, plus the share over all features."""
    ratios = [(F.count(c) / F.count(F.lit(1))).alias(c) for c in names]
    both = pan.groupBy("date").agg(*ratios)
    total = sum((F.col(c) for c in names), F.lit(0.0)) / F.lit(float(len(names)))
    return both.withColumn("all_features", total)


def to_long(pan: DataFrame, names: list[str], keys: tuple[str, ...] = ("date", "symbol")) -> DataFrame:
    """One row per key and feature."""
    return pan.unpivot(list(keys), list(names), "feature", "value")


def settled_calendar(bars: DataFrame) -> DataFrame:
    return settle(calendar(bars), "calendar")


def cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: clean(c) for c in columns})
