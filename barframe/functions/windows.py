"""Rolling aggregates, ready flags, cumulative series and EWMA over one ordered key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.functions.scalar import clean
from barframe.plans import segments as sg


def frame(w: WindowSpec, size: int) -> WindowSpec:
    return w.rowsBetween(-(size - 1), 0)


_AGGS = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_pop,
    "std_samp": F.stddev_samp,
    "last": lambda c: F.last(c),
    "values": F.collect_list,
}


def rolling(w: WindowSpec, column: str | Column, size: int, agg: str, full: bool = False, ddof: int = 0) -> Column:
    """Aggregate over the last ``size`` rows; with ``full`` NULL until ``size`` values are present.

    ``std`` takes ``ddof`` 0 or 1 and is NULL while the number of values is not above it.
    """
    c = F.col(column) if isinstance(column, str) else column
    over = frame(w, size)
    if agg == "std" and ddof == 1:
        agg = "std_samp"
    elif agg == "std" and ddof != 0:
        raise ValueError(f"ddof must be 0 or 1, got {ddof}")
    out = _AGGS[agg](c).over(over)
    return F.when(F.count(c).over(over) == size, out) if full else out


def ready(w: WindowSpec, column: str, size: int) -> Column:
    return F.count(F.col(column)).over(frame(w, size)) == size


def roll(
    df: DataFrame,
    specs: dict[str, tuple[str, int, str]],
    by: str | list[str] = "symbol",
    order: str = "date",
    full: bool = False,
    ddof: int = 0,
    rows: int = sg.SEGMENT_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Add ``{out: (column, size, agg)}`` rolling columns; long keys are cut into segments."""
    widest = max(size for _, size, _ in specs.values())
    seg = sg.segment(df, by, order, before=widest - 1, rows=rows, longest=longest)
    w = seg.window(order)
    out = seg.df.withColumns({k: rolling(w, c, n, a, full, ddof) for k, (c, n, a) in specs.items()})
    return seg.finish(out).select(*df.columns, *specs)


def _join_falls(blocks: list[tuple[Column, Column, Column]]) -> tuple[Column, Column, Column]:
    """(peak, low, fall) of adjoining blocks given oldest first."""
    falls = [fall for _, _, fall in blocks]
    for i in range(1, len(blocks)):
        peaks = [peak for peak, _, _ in blocks[:i]]
        peak = F.greatest(*peaks) if i > 1 else peaks[0]
        falls.append((blocks[i][1] - peak) / F.when(peak > 0, peak).otherwise(F.lit(1.0)))
    return F.greatest(*[b[0] for b in blocks]), F.least(*[b[1] for b in blocks]), F.least(*falls)


def with_drawdown(df: DataFrame, w: WindowSpec, column: str, size: int, out: str) -> DataFrame:
    """Deepest fall from an earlier peak over the last ``size`` rows, a non-positive fraction.

    A frame is not a sum, so it is joined from lagged blocks of 1, 4, 16, 64 ... rows: the cost per row
    grows with the logarithm of ``size`` and stays in generated code. Short frames give the fall so far.
    """
    parts = ("peak", "low", "fall")

    def col(length: int, part: str) -> str:
        return f"_dd{length}_{part}"

    def joined(d: DataFrame, lengths: list[int], names: dict[str, str], keep: list[str]) -> DataFrame:
        lags: dict[str, Column] = {}
        blocks, offset = [], 0
        for i, length in enumerate(lengths):  # newest first
            for p in parts:
                if i:
                    lags[f"_dl{i}_{p}"] = F.lag(col(length, p), offset).over(w)
            blocks.append(tuple(F.col(f"_dl{i}_{p}" if i else col(length, p)) for p in parts))
            offset += length
        d = d.withColumns(lags) if lags else d
        merged = dict(zip(parts, _join_falls(blocks[::-1])))
        return d.select(*keep, *[merged[p].alias(n) for p, n in names.items()])

    price, kept = F.col(column), list(df.columns)
    d = df.withColumns({col(1, "peak"): price, col(1, "low"): price, col(1, "fall"): price * 0.0})
    lengths = [1]
    while lengths[-1] * 4 <= size:
        longer = lengths[-1] * 4
        known = [*kept, *[col(n, p) for n in lengths for p in parts]]
        d = joined(d, [lengths[-1]] * 4, {p: col(longer, p) for p in parts}, known)
        lengths.append(longer)
    pieces, rest = [], size
    for length in reversed(lengths):
        pieces += [length] * (rest // length)
        rest %= length
    return joined(d, pieces, {"fall": out}, kept)


def valid_run(w: WindowSpec, column: str, position: str = "n") -> Column:
    """Rows since the last missing value: a frame of ``k`` rows is complete when this is at least ``k``."""
    missing = F.max(F.when(F.col(column).isNull(), F.col(position))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.col(position) - F.coalesce(missing, F.lit(0))


def lag_return(w: WindowSpec, column: str = "close") -> Column:
    prev = F.lag(column).over(w)
    return F.when(prev > 0, F.col(column) / prev - 1)


EWMA_BLOCK = 32


def ewma(
    df: DataFrame,
    column: str,
    alpha: float,
    warmup: int = 1,
    by: str | list[str] = "symbol",
    order: str = "date",
    out: str = "ewma",
    rows: int = sg.SEGMENT_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """``v = alpha * x + (1 - alpha) * v`` seeded by the first value, NULL before ``warmup`` values.

    A missing value makes every later value of its key missing. ``EWMA_BLOCK`` steps of the recursion are the map
    ``v -> a * v + b``; values follow from the start of their block, and starts from the chained maps of the blocks
    before. Whole keys and segments (cut between blocks) share that arithmetic, so both give the same bits.
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError(f"alpha must be in (0, 1], got {alpha}")
    if warmup < 1:
        raise ValueError(f"warmup must be >= 1, got {warmup}")
    keys = sg.as_list(by)
    rows = -(-rows // EWMA_BLOCK) * EWMA_BLOCK
    seg = sg.segment(df.withColumn("_x", clean(column)), keys, order, rows=rows, longest=longest)
    d = seg.finish(seg.df)
    keep = 1.0 - alpha

    def blocks(x: np.ndarray) -> np.ndarray:
        """The recursion from 0 inside each block; a short last block is filled up with 0."""
        z = np.zeros(-(-len(x) // EWMA_BLOCK) * EWMA_BLOCK)
        z[: len(x)] = alpha * x
        z = z.reshape(-1, EWMA_BLOCK)
        for j in range(1, EWMA_BLOCK):
            z[:, j] += keep * z[:, j - 1]
        return z

    powers = keep ** np.arange(1, EWMA_BLOCK + 1)

    if seg.split:
        starts = _segment_starts(d, keys, order, blocks, float(powers[-1]))
        d = d.join(starts, [*keys, "_seg"], "left")
    else:
        d = d.withColumn("_start", F.lit(None).cast("double")).withColumn("_has", F.lit(False))

    fields = [f for f in d.schema.fields if f.name not in ("_x", "_start", "_has", "_seg", "_more", "n")]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])
    names = [f.name for f in fields]

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf["_x"].to_numpy(dtype=float)
        start = float(pdf["_start"].iloc[0]) if bool(pdf["_has"].iloc[0]) else x[0]
        z = blocks(x)
        begin = np.empty(len(z))
        for i in range(len(z)):
            begin[i] = start
            start = powers[-1] * start + z[i, -1]
        v = (z + powers[None, :] * begin[:, None]).ravel()[: len(x)]
        if not bool(pdf["_has"].iloc[0]):
            v[0] = x[0]
        v[pdf["n"].to_numpy() < warmup] = np.nan
        res = pdf[names].copy()
        res[out] = v
        return res

    done = d.groupBy(*seg.keys).applyInPandas(replay, schema)
    return done.withColumn(out, clean(out))


def _segment_starts(d: DataFrame, keys: list[str], order: str, blocks, power: float) -> DataFrame:
    """Value of the recursion at the start of every later segment: the maps of all blocks before it, chained."""
    kept = [f for f in d.schema.fields if f.name in (*keys, "_seg")]
    part = T.StructType([*kept, T.StructField("_first", T.DoubleType()), T.StructField("_ends", T.ArrayType(T.DoubleType()))])

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf["_x"].to_numpy(dtype=float)
        row = {k: pdf[k].iloc[0] for k in (*keys, "_seg")}
        return pd.DataFrame([{**row, "_first": x[0], "_ends": list(blocks(x)[:, -1])}])

    maps = d.filter("_more").groupBy(*keys, "_seg", "_more").applyInPandas(summary, part)
    chained = T.StructType([*kept, T.StructField("_start", T.DoubleType()), T.StructField("_has", T.BooleanType())])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seg")
        v, starts = float(pdf["_first"].iloc[0]), []
        for ends in pdf["_ends"]:
            for b in ends:
                v = power * v + b
            starts.append(v)
        res = pdf[[*keys]].copy()
        res["_seg"] = pdf["_seg"] + 1
        res["_start"] = starts
        res["_has"] = True
        return res

    return maps.groupBy(*keys).applyInPandas(chain, chained)
