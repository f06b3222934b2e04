"""Null-safe scalar column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def clean(x: Column | str) -> Column:
    """NULL for NaN and the infinities, the value otherwise."""
    c = _c(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_div(a: Column | str | float, b: Column | str | float, default: float | None = None) -> Column:
    """``a / b``, or ``default`` (NULL) when the divisor is zero or missing."""
    a, b = _c(a), _c(b)
    out = F.when((b != 0) & ~F.isnan(b), a / b)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Hold ``x`` inside [lo, hi]; NULL stays NULL."""
    if lo > hi:
        raise ValueError(f"lo ({lo}) must be <= hi ({hi})")
    c = _c(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def bound(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """:func:`clip` for values known to be present: the expression is written once, so nesting stays cheap."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def winsorize(x: Column | str, lo: float = -3.0, hi: float = 3.0) -> Column:
    return clip(x, lo, hi)


def clamp01(x: Column | str) -> Column:
    return clip(x, 0.0, 1.0)


def keep_positive(x: Column | str) -> Column:
    c = _c(x)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def literal_case(column: str, values: dict[str, float], default: float | None = None) -> str:
    """Fixed look-up written as a SQL CASE, so no join is planned for it."""
    rest = "cast(null as double)" if default is None else f"{float(default)!r}d"
    if not values:
        return rest
    arms = " ".join(f"when {column} = '{k}' then {float(v)!r}d" for k, v in values.items())
    return f"case {arms} else {rest} end"
