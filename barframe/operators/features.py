"""The feature catalogue: fifteen rolling features per symbol, each with its own look-back.

All frames share one ``partitionBy(symbol).orderBy(date)`` window, so a feature table costs one shuffle and
one sort. Only the chosen features' columns are computed and only their inputs are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barframe.config import SQRT_252
from barframe.functions.scalar import clean, safe_div
from barframe.functions.windows import frame, valid_run, with_drawdown
from barframe.plans import segments as sg
from barframe.schema import require_columns

RV20_HISTORY = 252
RV20_HISTORY_MIN = 60


@dataclass(frozen=True)
class FeatureSpec:
    """``build`` gets the window and returns the column; ``needs`` names the shared parts it reads."""

    name: str
    lookback: int
    inputs: tuple[str, ...]
    build: Callable[[WindowSpec], Column]
    needs: tuple[str, ...] = ()


@dataclass
class Catalogue:
    specs: dict[str, FeatureSpec] = field(default_factory=dict)

    def add(self, spec: FeatureSpec) -> None:
        self.specs[spec.name] = spec

    def names(self) -> list[str]:
        return list(self.specs)

    def get(self, name: str) -> FeatureSpec:
        if name not in self.specs:
            raise ValueError(f"unknown feature {name!r}")
        return self.specs[name]

    def max_lookback(self, names: list[str] | None = None) -> int:
        return max((self.get(n).lookback for n in names or self.names()), default=0)

    def required_inputs(self, names: list[str] | None = None) -> list[str]:
        return sorted({i for n in names or self.names() for i in self.get(n).inputs})


def _change(past: str) -> Column:
    """Price change since an earlier close; NULL unless that close is positive."""
    return F.when(F.col(past) > 0, F.col("close") / F.col(past) - 1)


def _mean(size: int) -> Callable[[WindowSpec], Column]:
    return lambda w: F.when(F.col("_run") >= size, F.col(f"_m{size}"))


def _vol(size: int, least: int) -> Column:
    """Sample deviation of the returns in the frame, given at least ``least`` of them and ``size`` bars."""
    return F.when((F.col("n") >= size) & (F.col(f"_c{size}") >= least), F.col(f"_s{size}"))


# Shared parts by stage, with the parts they read. Window columns and the arithmetic on them sit in
# different stages: a window expression written twice inside one formula would be computed twice.
_STAGES: list[dict[str, tuple[Callable[[WindowSpec], Column], tuple[str, ...]]]] = [
    {
        "_lc": (lambda w: F.log(F.greatest(F.col("close"), F.lit(1e-10))), ()),
        "_dv": (lambda w: F.col("close") * F.col("volume"), ()),
    },
    {
        "_run": (lambda w: valid_run(w, "close"), ()),
        **{f"_p{k}": (lambda w, k=k: F.lag("close", k).over(w), ()) for k in (1, 5, 21, 63)},
        **{f"_m{k}": (lambda w, k=k: F.avg("close").over(frame(w, k)), ()) for k in (20, 50, 200)},
        "_mdv": (lambda w: F.avg("_dv").over(frame(w, 20)), ("_dv",)),
        "_cdv": (lambda w: F.count("_dv").over(frame(w, 20)), ("_dv",)),
        "_lc1": (lambda w: F.lag("_lc").over(w), ("_lc",)),
        "_fit": (lambda w: F.regr_slope(F.col("_lc"), F.col("n")).over(frame(w, 50)), ("_lc",)),
    },
    {
        "_ret": (lambda w: _change("_p1"), ("_p1",)),
        "_lr": (lambda w: F.col("_lc") - F.col("_lc1"), ("_lc", "_lc1")),
        **{f"_sma{k}": (_mean(k), ("_run", f"_m{k}")) for k in (20, 50, 200)},
    },
    {
        **{f"_c{k}": (lambda w, k=k: F.count("_ret").over(frame(w, k)), ("_ret",)) for k in (20, 60)},
        **{f"_s{k}": (lambda w, k=k: F.stddev_samp("_ret").over(frame(w, k)), ("_ret",)) for k in (20, 60)},
        "_slr": (lambda w: F.stddev_samp("_lr").over(frame(w, 49)), ("_lr",)),
    },
    {"_vol20": (lambda w: _vol(20, 15), ("_c20", "_s20"))},
]


def default_catalogue() -> Catalogue:
    cat = Catalogue()
    close, both, c = ("close",), ("close", "volume"), F.col

    def add(name: str, lookback: int, inputs: tuple[str, ...], build: Callable[[], Column], *needs: str) -> None:
        cat.add(FeatureSpec(name, lookback, inputs, lambda w: build(), needs))

    for name, days in (("ret1", 1), ("mom5", 5), ("mom21", 21), ("mom63", 63)):
        add(name, days, close, lambda d=days: _change(f"_p{d}"), f"_p{days}")
    for size in (20, 50, 200):
        add(f"sma{size}", size, close, lambda k=size: c(f"_sma{k}"), f"_sma{size}")
    add("trend_gap", 200, close, lambda: safe_div(c("_sma50") - c("_sma200"), c("_sma200")), "_sma50", "_sma200")
    add("rv20", 20, close, lambda: c("_vol20") * F.lit(SQRT_252), "_vol20")
    add("rv60", 60, close, lambda: _vol(60, 45) * F.lit(SQRT_252), "_c60", "_s60")
    add("rv20_z", 252, close, lambda: c("_score"), "_vol20", "_score")
    add("adv20", 20, both, lambda: F.when(c("_cdv") >= 20, c("_mdv")), "_mdv", "_cdv")
    add("dev20", 20, close, lambda: safe_div(c("close") - c("_sma20"), c("_sma20") * c("_vol20")), "_sma20", "_vol20")
    add("max_dd_90", 90, close, lambda: F.when(c("n") >= 90, c("_dd90")), "_dd90")
    add("normalized_slope", 50, close, lambda: F.when(c("_run") >= 50, safe_div("_fit", "_slr")), "_fit", "_slr", "_run")
    return cat


CATALOGUE = default_catalogue()
FEATURES = CATALOGUE.names()


def with_parts(df: DataFrame, w: WindowSpec, needs: set[str]) -> DataFrame:
    """Add the shared parts in ``needs`` over window ``w`` (``df`` has ``close`` and ``n``)."""
    needs = set(needs)
    for stage in reversed(_STAGES):
        for name, (_, after) in stage.items():
            if name in needs:
                needs.update(after)
    for stage in _STAGES:
        chosen = {k: build(w) for k, (build, _) in stage.items() if k in needs}
        if chosen:
            df = df.withColumns(chosen)
    return with_drawdown(df, w, "close", 90, "_dd90") if "_dd90" in needs else df


def _with_score(df: DataFrame, over: WindowSpec, seen: Column) -> DataFrame:
    """Score of the newest rv20 against the frame's values, ``seen`` valid ones having passed so far."""
    d = df.withColumns({"_mu": F.avg("_rv").over(over), "_sd": F.stddev_samp("_rv").over(over), "_seen": seen})
    enough = (F.col("_seen") >= RV20_HISTORY_MIN) & (F.col("_sd") > 0)
    return d.withColumn("_score", F.when(enough, (F.col("_rv") - F.col("_mu")) / F.col("_sd")))


def _with_history_score(df: DataFrame, seg: sg.Segments, by: list[str], order: str, rows: int) -> DataFrame:
    """Score of the last valid rv20 against the last 252 valid ones, carried over bars without one.

    The frame counts valid values, not bars, so valid rows get a window of their own inside the same
    partitioning (a sort, no shuffle). In segments the valid values are numbered and cut on their own, then
    every bar picks the score of the valid value it saw last.
    """
    d = df.withColumn("_rv", F.col("_vol20") * F.lit(SQRT_252)).withColumn("_ok", F.col("_rv").isNotNull())
    if not seg.split:
        valid = Window.partitionBy(*seg.keys, "_ok").orderBy(order)
        d = _with_score(d, frame(valid, RV20_HISTORY), F.row_number().over(valid))
        d = d.withColumn("_last", F.when(F.col("_ok"), F.struct(F.col("_score").alias("z"))))
        held = F.last("_last", ignorenulls=True).over(seg.window(order).rowsBetween(Window.unboundedPreceding, 0))
        return d.withColumn("_score", held["z"])
    d = seg.finish(d)
    vs = sg.segment(d.filter("_ok").select(*by, order, "_rv"), by, order, before=RV20_HISTORY - 1, rows=rows)
    scored = _with_score(vs.df, frame(vs.window(order), RV20_HISTORY), F.col("n"))
    scores = vs.finish(scored).select(*by, F.col("n").alias("_v"), "_score")
    d = sg.numbered(d, by, order, "_v", F.col("_ok"))
    return d.join(scores, [*by, "_v"], "left")


def features(
    bars: DataFrame,
    names: list[str] | None = None,
    keep: tuple[str, ...] = ("close",),
    by: str | list[str] = "symbol",
    order: str = "date",
    catalogue: Catalogue | None = None,
    rows: int = sg.SEGMENT_ROWS,
    longest: int | None = None,
    parity_float32: bool = False,
) -> DataFrame:
    """Feature table: keys, bar position ``n``, ``next_date`` (the symbol's next bar), ``keep``, features.

    A feature is NULL until its own look-back is filled, whichever other features are asked for.
    """
    cat = catalogue or CATALOGUE
    names = list(names) if names is not None else cat.names()
    specs = [cat.get(n) for n in names]
    by = sg.as_list(by)
    inputs = sorted({*cat.required_inputs(names), *keep}) if names else list(keep)
    require_columns(bars, [*by, order, *inputs])
    src = bars.select(*by, order, *[clean(c).alias(c) for c in inputs])

    seg = sg.segment(src, by, order, before=cat.max_lookback(names) + 1, after=1, rows=rows, longest=longest)
    w = seg.window(order)
    d = seg.df.withColumn("next_date", F.lead(order).over(w))
    needs = {n for s in specs for n in s.needs}
    d = with_parts(d, w, needs)
    scored = [s for s in specs if "_score" in s.needs]
    plain = {s.name: s.build(w) for s in specs if s not in scored}
    if plain:
        d = d.withColumns(plain)
    if "_score" in needs:
        d = _with_history_score(d, seg, by, order, rows).withColumns({s.name: s.build(w) for s in scored})
    if seg.split and "_halo" in d.columns:
        d = seg.finish(d)
    as_stored = (lambda c: F.col(c).cast("float")) if parity_float32 else F.col
    values = [clean(as_stored(n)).alias(n) for n in names]
    return d.select(*by, order, "n", "next_date", *[k for k in keep if k not in names], *values)
