"""Column selection, NULL handling and label predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.config import MARKET_LABELS, STOCK_LABELS
from barframe.functions.scalar import literal_case
from barframe.schema import require_columns


def select_features(df: DataFrame, features: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """``keep`` then ``features`` in order, repeated names once; raises on a missing feature."""
    features = list(features)
    require_columns(df, features)
    return df.select(*dict.fromkeys([*keep, *features]))


def drop_incomplete(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def market_flags(df: DataFrame, label: str = "label") -> DataFrame:
    c = F.col(label)
    return df.withColumns(
        {
            "is_stressed": c.isin("stress", "crisis"),
            "is_calm": c.isin("calm_trend", "calm_range"),
            "is_trending": c == "calm_trend",
        }
    )


def stock_flags(df: DataFrame, label: str = "label") -> DataFrame:
    c = F.col(label)
    return df.withColumns(
        {
            "is_tradeable": c != "no_trade",
            "is_trending": c.isin("trending_up", "trending_down"),
            "is_trending_up": c == "trending_up",
            "is_trending_down": c == "trending_down",
            "is_ranging": c == "range_low_vol",
            "is_stressed": c == "stressed_high_vol",
        }
    )


def filter_label(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col("label") == label)


def filter_tradeable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label") != "no_trade")


def filter_confidence(df: DataFrame, minimum: float) -> DataFrame:
    return df.filter(F.col("confidence") >= minimum)


def label_code(column: str) -> Column:
    """Numeric code of a market or stock label, -1 for any other text."""
    codes = {name: float(i) for names in (MARKET_LABELS, STOCK_LABELS) for i, name in enumerate(names)}
    return F.expr(literal_case(column, codes, -1.0))
