"""Rolling features over arriving bars, with Spark's own keyed state.

``FeatureProcessor`` runs under ``transformWithState``. It keeps two lists per symbol: the last ``REACH + revise`` bars (date, close,
volume, volatility) and the last ``RV20_HISTORY`` valid volatilities before them. A batch's bars are merged into the list by date; from the
first new or changed date on, the features are computed with numpy over the list and emitted. So an ordinary bar costs its own row,
and a late or corrected bar emits again exactly the rows after it, whose position or frames hold it, with a higher version.

Of bars with one symbol and date the one with the larger (volume, close) counts, as in the batch job, whenever it comes. A late bar older than
the kept list cannot be merged any more: it is emitted with ``late`` set and without features. State is bounded by the two lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barframe.config import SQRT_252
from barframe.functions.scalar import clean
from barframe.operators import features as ft
from barframe.sources.bars import dedupe_last
from barframe.streaming.state import require_rocksdb

KEEP = ("close", "volume")
REACH = ft.CATALOGUE.max_lookback() + 1
REVISE = 64
_VOL_BARS = 20
_NUMBERS = T.ArrayType(T.DoubleType())
_BAR = T.StructType([T.StructField("at", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in (*KEEP, "vol")]])
_VOL = T.StructType([T.StructField("vol", T.DoubleType())])
_HEAD = T.StructType([T.StructField("first", T.LongType()), T.StructField("version", T.LongType())])
_OUT = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()),
     T.StructField("version", T.LongType()), T.StructField("late", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in (*KEEP, *ft.FEATURES)]]
)


def _frames(x: np.ndarray, size: int) -> np.ndarray:
    """Row i holds the ``size`` values up to x[i]; missing ones before the start are NaN."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(size - 1, np.nan), x]), size)


def _back(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(len(x) - k, 0)]])


def _spread(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid values in each frame, and their sample deviation (NaN below two)."""
    f = _frames(x, size)
    count = np.isfinite(f).sum(axis=1)
    mean = np.nansum(f, axis=1) / np.maximum(count, 1)
    square = np.nansum((f - mean[:, None]) ** 2, axis=1)
    return count, np.where(count > 1, np.sqrt(square / np.maximum(count - 1, 1)), np.nan)


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b != 0, a / np.where(b != 0, b, 1), np.nan)


def _fall(x: np.ndarray, size: int) -> np.ndarray:
    f = _frames(x, size)
    peak = np.fmax.accumulate(f, axis=1)
    depth = np.where(np.isfinite(f), (f - peak) / np.where(peak > 0, peak, 1.0), 0.0)
    return np.where(np.isfinite(f).any(axis=1), depth.min(axis=1), np.nan)


def _scores(vol: np.ndarray, older: np.ndarray) -> np.ndarray:
    """Each bar's score of the last valid volatility against the 252 valid ones up to it."""
    rv = np.concatenate([older, vol[np.isfinite(vol)]]) * SQRT_252
    if not len(rv):
        return np.full(len(vol), np.nan)
    count, sd = _spread(rv, ft.RV20_HISTORY)
    f = _frames(rv, ft.RV20_HISTORY)
    mean = np.nansum(f, axis=1) / count
    ok = (count >= ft.RV20_HISTORY_MIN) & (sd > 0)
    z = np.where(ok, (rv - mean) / np.where(ok, sd, 1.0), np.nan)
    seen = len(older) + np.cumsum(np.isfinite(vol))
    return np.where(seen > 0, z[np.maximum(seen - 1, 0)], np.nan)


def window_features(close: np.ndarray, volume: np.ndarray, first: int, known_vol: np.ndarray, older: np.ndarray, start: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features of the bars from index ``start`` on, and the volatility of all bars.

    ``first`` is the position of the first bar in its symbol. Where earlier bars are gone, the first ``_VOL_BARS`` bars keep their
    ``known_vol``, and ``older`` holds the valid volatilities before the first bar.
    """
    n = np.arange(first, first + len(close))
    with np.errstate(all="ignore"):
        past = _back(close, 1)
        ret = np.where(past > 0, close / past - 1, np.nan)
        count, sd = _spread(ret, _VOL_BARS)
        vol = np.where((n >= _VOL_BARS) & (count >= 15), sd, np.nan)
        if first > 1:
            vol[:_VOL_BARS] = known_vol[:_VOL_BARS]
        lo = max(start - REACH + 1, 0)
        score = _scores(vol, older)[start:]
        close, volume, ret, n, own = close[lo:], volume[lo:], ret[lo:], n[lo:], vol[lo:]
        gap = np.maximum.accumulate(np.where(np.isfinite(close), -1, np.arange(len(close))))
        run = np.arange(len(close)) - gap
        change = lambda k: np.where(_back(close, k) > 0, close / _back(close, k) - 1, np.nan)
        mean = {k: np.where(run >= k, _frames(close, k).mean(axis=1), np.nan) for k in (20, 50, 200)}
        log = np.log(np.fmax(close, 1e-10))
        log = np.where(np.isfinite(close), log, np.nan)
        x = np.arange(50) - 24.5
        slope = np.where(run >= 50, _frames(log, 50) @ x / (x @ x), np.nan)
        c60, s60 = _spread(ret, 60)
        traded = _frames(close * volume, 20)
        out = {f"mom{k}": change(k) for k in (5, 21, 63)} | {f"sma{k}": v for k, v in mean.items()}
        out["ret1"] = ret
        out["trend_gap"] = _divide(mean[50] - mean[200], mean[200])
        out["rv20"] = own * SQRT_252
        out["rv60"] = np.where((n >= 60) & (c60 >= 45), s60, np.nan) * SQRT_252
        out["adv20"] = traded.mean(axis=1)
        out["dev20"] = _divide(close - mean[20], mean[20] * own)
        out["max_dd_90"] = np.where(n >= 90, _fall(close, 90), np.nan)
        out["normalized_slope"] = _divide(slope, _spread(log - _back(log, 1), 49)[1])
    out = {k: v[start - lo :] for k, v in out.items()}
    out["rv20_z"] = score
    return out, vol


class FeatureProcessor(StatefulProcessor):
    """Bars of a symbol in, features of new and changed bars out."""

    def __init__(self, revise: int) -> None:
        self.revise = revise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", _BAR)
        self.older = handle.getListState("older", _VOL)
        self.head = handle.getValueState("head", _HEAD)

    def _load(self):
        bars = np.array([tuple(np.nan if v is None else v for v in b) for b in self.bars.get()], dtype=float).reshape(-1, 4)
        older = np.array([v[0] for v in self.older.get()], dtype=float)
        first, version = self.head.get() if self.head.exists() else (1, 0)
        return bars, older, int(first), int(version)

    def _keep(self, bars: np.ndarray, older: np.ndarray, first: int, version: int) -> None:
        gone = max(len(bars) - REACH - self.revise, 0)
        passed = bars[:gone, 3]
        older = np.concatenate([older, passed[np.isfinite(passed)]])[-ft.RV20_HISTORY :]
        value = lambda v: None if np.isnan(v) else float(v)
        self.bars.put([(int(at), value(c), value(q), value(s)) for at, c, q, s in bars[gone:]])
        if len(older):
            self.older.put([(float(v),) for v in older])
        self.head.update((first + gone, version))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[["at", *KEEP]].astype(float)
        bars, older, first, version = self._load()
        late = new.iloc[:0]
        if first > 1:
            # A row needs REACH bars up to it: nothing before that many kept bars can change any more.
            early = new["at"] <= bars[REACH - 1, 0]
            held = pd.MultiIndex.from_arrays(bars[:, :3].T)
            late, new = new[early & ~pd.MultiIndex.from_frame(new).isin(held)], new[~early]
        old = pd.DataFrame(bars[:, :3], columns=["at", *KEEP])
        merged = pd.concat([old, new]).sort_values(["at", "volume", "close"], kind="stable", na_position="first").drop_duplicates("at", keep="last")
        table = merged.to_numpy()
        before = bars[np.minimum(np.searchsorted(bars[:, 0], table[:, 0]), len(bars) - 1), :3] if len(bars) else np.full(table.shape, np.nan)
        changed = np.flatnonzero(~((before == table) | (np.isnan(before) & np.isnan(table))).all(axis=1))
        frames = []
        if len(changed):
            start = int(changed[0])
            known = np.concatenate([bars[:, 3], np.full(max(len(table) - len(bars), 0), np.nan)])
            values, vol = window_features(table[:, 1], table[:, 2], first, known, older, start)
            version += 1
            frames.append(pd.DataFrame({"at": table[start:, 0].astype(np.int64), "n": np.arange(first + start, first + len(table)), "version": version, "late": False,
                                        "close": table[start:, 1], "volume": table[start:, 2], **values}))
            self._keep(np.column_stack([table, vol]), older, first, version)
        if len(late):
            frames.append(late.astype({"at": "int64"}).assign(n=pd.NA, version=version, late=True, **dict.fromkeys(ft.FEATURES, np.nan)))
        for f in frames:
            f["symbol"] = key[0]
            f["n"] = f["n"].astype("Int64")
            yield f[[c.name for c in _OUT.fields]]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        bars = np.array([[np.nan if v is None else v for v in (b["at"], b["close"], b["volume"], b["vol"])] for b in row["bars"]], dtype=float).reshape(-1, 4)
        self._keep(bars, np.array(list(row["older"]), dtype=float), int(row["first"]), 1)

    def close(self) -> None:
        pass


def end_state(bars: DataFrame, revise: int = REVISE) -> DataFrame:
    """The processor's state (symbol, first, bars, older) after a batch of bars, to start a stream from."""
    b = dedupe_last(bars.select("symbol", "date", *KEEP), ["symbol", "date"], ["volume", "close"])
    f = ft.features(b, ["rv20"], keep=KEEP).withColumn("vol", F.col("rv20") / F.lit(SQRT_252))
    kept = REACH + revise
    newest = Window.partitionBy("symbol").orderBy(F.desc("n"))
    d = f.withColumn("_back", F.row_number().over(newest))
    d = d.withColumn("_valid", F.count("vol").over(newest) - F.count(F.when(F.col("_back") <= kept, F.col("vol"))).over(Window.partitionBy("symbol")))
    bar = F.struct("n", F.unix_date("date").cast("long").alias("at"), *KEEP, "vol")
    old = F.when((F.col("_back") > kept) & (F.col("_valid") <= ft.RV20_HISTORY) & F.col("vol").isNotNull(), F.struct("n", "vol"))
    return d.filter((F.col("_back") <= kept) | (F.col("_valid") <= ft.RV20_HISTORY)).groupBy("symbol").agg(
        F.min(F.when(F.col("_back") <= kept, F.col("n"))).alias("first"),
        F.sort_array(F.collect_list(F.when(F.col("_back") <= kept, bar))).alias("bars"),
        F.transform(F.sort_array(F.collect_list(old)), lambda x: x["vol"]).alias("older"),
    )


def stream_features(bars: DataFrame, start: DataFrame | None = None, revise: int = REVISE) -> DataFrame:
    """Features of a stream of bars: symbol, date, n, version, late, close, volume, features; needs the RocksDB state store.

    A row is emitted again with a higher ``version`` when a late or corrected bar changes it; ``late`` marks bars that came more than
    ``revise`` bars too late. ``start`` (see :func:`end_state`) continues from a batch of history.
    """
    require_rocksdb(bars.sparkSession)
    rows = bars.select("symbol", F.unix_date("date").cast("long").alias("at"), *[clean(c).alias(c) for c in KEEP])
    out = rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=FeatureProcessor(revise), outputStructType=_OUT, outputMode="append", timeMode="none",
        initialState=start.groupBy("symbol") if start is not None else None,
    )
    values = [clean(c).alias(c) for c in (*KEEP, *ft.FEATURES)]
    return out.select("symbol", F.expr("date_from_unix_date(cast(at as int))").alias("date"), "n", "version", "late", *values)


def newest(rows: DataFrame) -> DataFrame:
    """The last version of every (symbol, date) among the emitted rows; bars set aside are left out."""
    cols = [c for c in rows.columns if c not in ("symbol", "date", "late")]
    d = rows.filter(~F.col("late")).groupBy("symbol", "date").agg(F.max_by(F.struct(*cols), "version").alias("_r"))
    return d.select("symbol", "date", "_r.*")
