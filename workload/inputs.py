"""Shared inputs of the registered queries, each derived from the given tables and written once per session."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe import demo
from barframe.config import STOCK_LABELS, MarketRegimeConfig, StockRegimeConfig
from barframe.operators import features as ft
from barframe.operators import market_regime as mr
from barframe.operators import panel as pn
from barframe.operators import stock_regime as sr
from barframe.plans.settle import settle

_kept: dict[tuple[str, str, str], DataFrame] = {}
_lock = threading.RLock()


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _lock:
        if key not in _kept:
            _kept[key] = settle(build(), name)
        return _kept[key]


def forget() -> None:
    """Drop the written inputs, so the next query derives them again."""
    with _lock:
        _kept.clear()
        demo.forget()


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.bars(spark, sf_dir, "brand")


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.bars(spark, sf_dir, "market")


def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.bars(spark, sf_dir, "brand+market")


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda: ft.features(bars(spark, sf_dir), keep=("close", "volume"))
    return once(spark, sf_dir, "features", build)


def cal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "calendar", lambda: pn.calendar(all_bars(spark, sf_dir)))


def panel(spark: SparkSession, sf_dir: str, names: list[str] | None = None, start: str | None = None) -> DataFrame:
    return pn.panel(feats(spark, sf_dir), cal(spark, sf_dir), names or ft.FEATURES, start=start)


def market_feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "market-features", lambda: mr.market_features(market_bars(spark, sf_dir)))


def market_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market label per date without hysteresis: the raw proposal, or crisis in a very deep drawdown."""

    def build() -> DataFrame:
        d = mr.proposals(market_feats(spark, sf_dir).filter(F.col("n") >= 200), MarketRegimeConfig())
        raw = F.element_at(F.array(*[F.lit(x) for x in mr.RAW]), F.col("raw_2") + 1)
        label = F.when(F.col("max_dd") < -0.30, "crisis").otherwise(mr.public_label(raw))
        return d.select("date", label.alias("label"), F.col("conf_2").alias("confidence"))

    return once(spark, sf_dir, "market-rule", build)


def stock_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stock label per bar without hysteresis: the raw proposal from a neutral state."""

    def build() -> DataFrame:
        d = sr.signals(feats(spark, sf_dir)).withColumn("market_stressed", F.lit(False))
        d = sr.proposals(d, StockRegimeConfig())
        label = F.element_at(F.array(*[F.lit(x) for x in STOCK_LABELS]), F.col("raw_2") + 1)
        return d.select("symbol", "date", label.alias("label"), F.col("conf_2").alias("confidence"))

    return once(spark, sf_dir, "stock-rule", build)


def market_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda: mr.market_regime(market_feats(spark, sf_dir), mode="live")
    return once(spark, sf_dir, "market-states", build)


def stock_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda: sr.stock_regime(
        panel(spark, sf_dir, sr.INPUTS), market_states(spark, sf_dir)
    )
    return once(spark, sf_dir, "stock-states", build)
