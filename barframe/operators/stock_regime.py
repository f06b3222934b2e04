"""Regime of every symbol on every panel date, given the market regime of that date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.config import STOCK_LABELS, StockRegimeConfig
from barframe.functions.scalar import bound
from barframe.operators import hysteresis as hy
from barframe.plans import segments as sg
from barframe.schema import require_columns

UP, DOWN, RANGE, STRESSED, NO_TRADE = range(5)
SIGNALS = ["normalized_slope", "daily_vol", "vol_z", "max_dd", "mom63", "ma_trend", "rv20"]
INPUTS = ["normalized_slope", "rv20", "rv20_z", "max_dd_90", "mom63", "trend_gap"]


def signals(panel: DataFrame, cfg: StockRegimeConfig = StockRegimeConfig()) -> DataFrame:
    """Signal columns; slope and volatility are required, the others default to 0.

    ``tradeable`` is false where a required signal is missing.
    """
    require_columns(panel, INPUTS)
    zero = F.lit(0.0)
    gap = F.col("trend_gap")
    return panel.select(
        *[c for c in panel.columns if c not in (*INPUTS, *SIGNALS)],
        "normalized_slope",
        (F.col("rv20") / cfg.annualization).alias("daily_vol"),
        F.coalesce("rv20_z", zero).alias("vol_z"),
        F.coalesce("max_dd_90", zero).alias("max_dd"),
        F.coalesce("mom63", zero).alias("mom63"),
        F.when(gap.isNull(), 0.0).when(gap > 0, 1.0).otherwise(-1.0).alias("ma_trend"),
        "rv20",
        (F.col("normalized_slope").isNotNull() & F.col("rv20").isNotNull()).alias("tradeable"),
    )


def _stress(z_limit: Column, dd_limit: float) -> tuple[Column, Column]:
    by_vol, by_fall = F.col("vol_z") >= z_limit, F.col("max_dd") <= dd_limit
    vol = F.when(by_vol, (F.col("vol_z") - z_limit) / 2.0).otherwise(0.0)
    fall = F.when(by_fall, (F.lit(dd_limit) - F.col("max_dd")) / abs(dd_limit) / 2.0).otherwise(0.0)
    return by_vol | by_fall, bound(0.55 + F.greatest(vol, fall) * 0.45)


def _trend_confidence(cfg: StockRegimeConfig, way: float) -> Column:
    steep, mom = F.abs("normalized_slope"), F.abs("mom63")
    agree = F.when(F.col("ma_trend") * way > 0, 0.1).otherwise(-0.05)
    base = bound(0.5 + (steep - cfg.slope_exit) / 3.0)
    damp = F.when(F.col("market_stressed"), cfg.market_stress_penalty).otherwise(1.0)
    return bound(bound(base + agree + F.least(mom * 2.0, F.lit(1.0)) * 0.1) * damp)


def range_confidence(cfg: StockRegimeConfig = StockRegimeConfig()) -> Column:
    """Confidence in a quiet range; 0.45 when the slope is too steep for one."""
    steep = F.abs("normalized_slope")
    flat = bound(1.0 - steep / cfg.range_slope_ceil)
    calm = bound(1.0 - F.col("rv20") / cfg.low_vol_ceil) if cfg.low_vol_ceil > 0 else F.lit(0.5)
    return F.when(steep <= cfg.range_slope_ceil, bound(0.45 + 0.35 * flat + 0.20 * calm)).otherwise(0.45)


def proposals(df: DataFrame, cfg: StockRegimeConfig) -> DataFrame:
    """Raw label and confidence per class of previous label: up, down, neither, stressed.

    ``df`` has the signals and ``market_stressed``. A trend needs momentum of the slope's sign.
    """
    shift = F.when(F.col("market_stressed"), cfg.z_enter - cfg.market_stress_z_shift).otherwise(cfg.z_enter)
    enter, leave = _stress(shift, cfg.dd_enter), _stress(F.lit(cfg.z_exit), cfg.dd_exit)
    s, rising, falling = F.col("normalized_slope"), F.col("mom63") > 0, F.col("mom63") < 0
    shared = {
        "_hit_in": enter[0], "_cs_in": enter[1], "_hit_out": leave[0], "_cs_out": leave[1],
        "_up_hard": (s >= cfg.slope_enter) & rising, "_up_soft": (s >= cfg.slope_exit) & rising,
        "_down_hard": (s <= -cfg.slope_enter) & falling, "_down_soft": (s <= -cfg.slope_exit) & falling,
        "_c_up": _trend_confidence(cfg, 1.0), "_c_down": _trend_confidence(cfg, -1.0), "_c_range": range_confidence(cfg),
    }
    by_class = (("in", "soft", "hard"), ("in", "hard", "soft"), ("in", "hard", "hard"), ("out", "hard", "hard"))
    cols: dict[str, Column] = {}
    for k, (stress, up, down) in enumerate(by_class):
        tests = f"when not tradeable then {{0}} when _hit_{stress} then {{1}} when _up_{up} then {{2}} when _down_{down} then {{3}} else {{4}}"
        cols[f"raw_{k}"] = F.expr(f"case {tests.format(NO_TRADE, STRESSED, UP, DOWN, RANGE)} end")
        cols[f"conf_{k}"] = F.expr(f"case {tests.format('0d', f'_cs_{stress}', '_c_up', '_c_down', '_c_range')} end")
    return df.withColumns(shared).withColumns(cols).drop(*shared).withColumn("skip", F.lit(False))


def machine(cfg: StockRegimeConfig) -> hy.Machine:
    return hy.Machine(STOCK_LABELS, (0, 1, 2, 3, 2), 2, 4, cfg.min_duration, cfg.confidence_gate, instant=(STRESSED,))


def stock_regime(
    panel: DataFrame,
    market: DataFrame,
    cfg: StockRegimeConfig = StockRegimeConfig(),
    rows: int = sg.SEGMENT_ROWS,
    longest: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(symbol, date) label, confidence and signals for every row of ``panel``.

    ``market`` has one row per date (``date, label``); settled, it is small enough to be broadcast by size.
    ``carry`` names panel columns to pass along, which saves joining the labels back to the panel.
    """
    stressed = market.select("date", F.col("label").isin("stress", "crisis").alias("market_stressed"))
    extra = {f"_c_{c}": F.col(c) for c in carry}
    inputs = panel.withColumns(extra).select("symbol", "date", *INPUTS, *extra)
    d = signals(inputs, cfg).join(stressed, "date", "left")
    d = d.withColumn("market_stressed", F.coalesce("market_stressed", F.lit(False)))
    out = hy.run(proposals(d, cfg), machine(cfg), "symbol", rows=rows, longest=longest)
    reasons = F.when(F.col("tradeable"), F.struct(*SIGNALS))
    return out.select(
        "symbol", "date", "label", F.col("confidence"), "days_in_regime", "regime_start", reasons.alias("reasons"),
        *[F.col(f"_c_{c}").alias(c) for c in carry],
    )


def regime_counts(regimes: DataFrame, labels: tuple[str, ...] = STOCK_LABELS) -> DataFrame:
    """Rows per date and label, every label present; one aggregate, no label table to join."""
    counts = [F.count_if(F.col("label") == name).alias(name) for name in labels]
    return regimes.groupBy("date").agg(*counts).unpivot("date", list(labels), "label", "n")
