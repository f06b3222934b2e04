"""Net asset value and summary statistics of weight histories.

Everything here has one row per (portfolio, trading date), so windows over a portfolio are calendar-bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.config import TRADING_DAYS

BY = "portfolio_id"


def bar_returns(feats: DataFrame) -> DataFrame:
    """Return of each bar over the symbol's previous bar; a symbol without a bar that day earns 0."""
    return feats.select("symbol", "date", F.col("ret1").alias("ret")).filter(F.col("ret").isNotNull())


def daily_returns(weights: DataFrame, returns: DataFrame, cal: DataFrame) -> DataFrame:
    """Return of each portfolio on each trading date from the weights set on the date before.

    Positive weights of date t earn the return from t to the next trading date; nothing earlier or later.
    """
    nxt = cal.select("date", F.col("next_trading_date").alias("_earn")).filter(F.col("_earn").isNotNull())
    held = weights.filter(F.col("weight") > 0).join(nxt, "date")
    earned = held.select(BY, "symbol", F.col("_earn").alias("date"), "weight").join(returns, ["symbol", "date"])
    return earned.groupBy(BY, "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def nav(daily: DataFrame, portfolios: DataFrame, cal: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """Equity on every trading date, starting flat at ``cash``; a portfolio at or below zero stays there."""
    every = on_calendar(portfolios, cal)
    d = every.join(daily, [BY, "date"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    w = Window.partitionBy(BY).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("growth", F.product(1.0 + F.col("ret")).over(w))
    broke = F.min("growth").over(w.rowsBetween(Window.unboundedPreceding, -1)) <= 0
    first_loss = F.first(F.when(F.col("growth") <= 0, F.col("growth")), ignorenulls=True).over(w)
    d = d.withColumns({"_broke": broke, "_stuck": first_loss})
    return d.select(
        BY,
        "date",
        "ret",
        (F.lit(float(cash)) * F.when(F.col("_broke"), F.col("_stuck")).otherwise(F.col("growth"))).alias("nav"),
    )


def on_calendar(portfolios: DataFrame, cal: DataFrame) -> DataFrame:
    """Each portfolio on every trading date: its span of days, cut down to the calendar."""
    lo, hi = cal.agg(F.min("date"), F.max("date")).first()
    days = portfolios.select(BY).distinct().withColumn("date", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return days.join(cal.select("date"), "date", "left_semi")


def equity_path(equity: DataFrame) -> DataFrame:
    """Daily change, running peak and drawdown of each equity curve."""
    w = Window.partitionBy(BY).orderBy("date")
    peak = F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = equity.withColumns({"_prev": F.lag("nav").over(w), "peak": peak})
    return d.withColumns(
        {"change": F.col("nav") / F.col("_prev") - 1, "drawdown": F.col("nav") / F.col("peak") - 1}
    ).drop("_prev")


def positions_held(weights: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Rebalance count and mean number of positions per portfolio; a date without weights counts as 0."""
    held = weights.groupBy(BY, "date").agg(F.count_if(F.col("weight") > 0).alias("n"))
    d = rebalances.select(BY, "date").join(held, [BY, "date"], "left")
    return d.groupBy(BY).agg(
        F.count(F.lit(1)).alias("n_rebalances"), F.avg(F.coalesce("n", F.lit(0))).alias("avg_positions")
    )


def perf_stats(equity: DataFrame, weights: DataFrame, rebalances: DataFrame) -> DataFrame:
    """One row per portfolio: values, returns, volatility, Sharpe ratio, drawdown, counts.

    A series of fewer than two points reports zero return and drawdown and NULL for the rest.
    """
    d = equity_path(equity)
    agg = d.groupBy(BY).agg(
        F.count(F.lit(1)).alias("_points"),
        F.min_by("nav", "date").alias("initial_value"),
        F.max_by("nav", "date").alias("final_value"),
        F.avg("change").alias("_mean"),
        F.stddev_samp("change").alias("_sd"),
        F.count("change").alias("_days"),
        F.min("drawdown").alias("_dd"),
    )
    short = F.col("_points") < 2
    year = F.lit(float(TRADING_DAYS))

    def full(c: Column) -> Column:
        return F.when(~short, c)

    ann_ret = F.col("_mean") * year
    ann_vol = F.coalesce(F.when(F.col("_days") > 1, F.col("_sd") * F.sqrt(year)), F.lit(0.0))
    d = agg.withColumns({"_ret": ann_ret, "_vol": ann_vol}).select(
        BY,
        full(F.col("initial_value")).alias("initial_value"),
        full(F.col("final_value")).alias("final_value"),
        F.when(short, 0.0).otherwise(F.col("final_value") / F.col("initial_value") - 1).alias("total_return"),
        full(F.col("_ret")).alias("annualised_return"),
        full(F.col("_vol")).alias("annualised_vol"),
        full(F.when(F.col("_vol") > 0, F.col("_ret") / F.col("_vol")).otherwise(0.0)).alias("sharpe_ratio"),
        F.when(short, 0.0).otherwise(F.col("_dd")).alias("max_drawdown"),
        F.when(short, F.col("_points")).otherwise(F.col("_days")).alias("n_trading_days"),
    )
    return d.join(positions_held(weights, rebalances), BY, "left").withColumns(
        {"n_rebalances": F.coalesce("n_rebalances", F.lit(0)), "avg_positions": F.coalesce("avg_positions", F.lit(0.0))}
    )


def weights_matrix(weights: DataFrame, symbols: list[str]) -> DataFrame:
    """Dates by symbols for the given symbols, absent weights 0. The long form is the canonical one."""
    cols = [F.coalesce(F.sum(F.when(F.col("symbol") == s, F.col("weight"))), F.lit(0.0)).alias(s) for s in symbols]
    return weights.groupBy(BY, "date").agg(*cols)


def label_share(regimes: DataFrame) -> DataFrame:
    """Rows and share per label."""
    counts = regimes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def last_portfolio(weights: DataFrame) -> DataFrame:
    """Weights on each portfolio's last date, largest first."""
    last = weights.groupBy(BY).agg(F.max("date").alias("date"))
    return weights.join(last, [BY, "date"], "left_semi").orderBy(BY, F.desc("weight"), "symbol")
