"""Market regime of a benchmark (or of any key): features as window columns, labels by hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.config import MarketRegimeConfig
from barframe.functions.scalar import bound, clean, safe_div
from barframe.functions.windows import frame, with_drawdown
from barframe.operators import hysteresis as hy
from barframe.plans import segments as sg
from barframe.schema import require_columns

# Internal states, in code order.
RAW = ("calm_trending_up", "calm_trending_down", "choppy_normal", "stressed")
UP, DOWN, CHOPPY, STRESSED = range(4)
MARKET_FEATURES = ["log_return", "rv20_log", "vol_mean", "vol_sd", "z_vol", "max_dd", "normalized_slope",
                   "ma_short", "ma_long", "ma_flag"]


def public_label(raw: Column) -> Column:
    out = F.when(raw.isin("calm_trending_up", "calm_trending_down"), "calm_trend")
    return out.when(raw == "choppy_normal", "calm_range").when(raw == "stressed", "stress")


def market_features(
    bars: DataFrame,
    cfg: MarketRegimeConfig = MarketRegimeConfig(),
    by: str | list[str] = "symbol",
    order: str = "date",
    rows: int = sg.SEGMENT_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Volatility, its score against its own history, drawdown, trend slope and moving-average cross.

    Volatility here uses log returns, unlike the feature catalogue's simple returns.
    """
    by = sg.as_list(by)
    require_columns(bars, [*by, order, "close"])
    src = bars.select(*by, order, clean("close").alias("close"))
    reach = cfg.vol_lookback + cfg.rv_window
    before = max(reach, cfg.drawdown_window, cfg.trend_window, cfg.ma_long)
    seg = sg.segment(src, by, order, before=before, after=1, rows=rows, longest=longest)
    w, n = seg.window(order), F.col("n")
    d = seg.df.withColumn("_lc", F.log("close"))
    d = d.withColumns(
        {
            "next_date": F.lead(order).over(w),
            "_prev": F.lag("_lc").over(w),
            "_ma_s": F.avg("close").over(frame(w, cfg.ma_short)),
            "_ma_l": F.avg("close").over(frame(w, cfg.ma_long)),
            "_fit": F.regr_slope(F.col("_lc"), n).over(frame(w, cfg.trend_window)),
        }
    )
    d = d.withColumns(
        {
            "log_return": F.col("_lc") - F.col("_prev"),
            "ma_short": F.when(n >= cfg.ma_short, F.col("_ma_s")),
            "ma_long": F.when(n >= cfg.ma_long, F.col("_ma_l")),
        }
    )
    d = d.withColumns(
        {
            "_n20": F.count("log_return").over(frame(w, cfg.rv_window)),
            "_sd20": F.stddev_samp("log_return").over(frame(w, cfg.rv_window)),
            "_sdt": F.stddev_samp("log_return").over(frame(w, cfg.trend_window - 1)),
        }
    )
    d = d.withColumn("rv20_log", F.when(F.col("_n20") == cfg.rv_window, F.col("_sd20") * F.lit(cfg.annualization)))
    history = frame(w, cfg.vol_lookback)
    d = d.withColumns(
        {
            "_rvn": F.count("rv20_log").over(history),
            "_rvm": F.avg("rv20_log").over(history),
            "_rvs": F.stddev_samp("rv20_log").over(history),
        }
    )
    enough = F.col("_rvn") >= cfg.vol_lookback_min
    d = d.withColumns({"vol_mean": F.when(enough, F.col("_rvm")), "vol_sd": F.when(enough, F.col("_rvs"))})
    d = with_drawdown(d, w, "close", cfg.drawdown_window, "_dd")
    cross = (
        F.when(F.col("ma_short") > F.col("ma_long"), 1)
        .when(F.col("ma_short") < F.col("ma_long"), -1)
        .otherwise(0)
        .cast("int")
    )
    d = d.withColumns(
        {
            "z_vol": safe_div(F.col("rv20_log") - F.col("vol_mean"), "vol_sd"),
            "max_dd": F.when(n >= cfg.drawdown_window, F.col("_dd")),
            "normalized_slope": F.when(
                (n >= cfg.trend_window) & (F.col("_sdt") > 0), F.col("_fit") / F.col("_sdt")
            ),
            "ma_flag": cross,
        }
    )
    values = [clean(c).alias(c) if c != "ma_flag" else F.col(c) for c in MARKET_FEATURES]
    return seg.finish(d).select(*by, order, "n", "next_date", "close", *values)


def _stress(cfg: MarketRegimeConfig, z_limit: float, dd_limit: float) -> tuple[Column, Column]:
    z, dd = F.col("z_vol"), F.col("max_dd")
    hit = F.coalesce(z > z_limit, F.lit(False)) | F.coalesce(dd < dd_limit, F.lit(False))
    vol = F.coalesce((z - z_limit) / cfg.margin_scale, F.lit(0.0))
    fall = F.coalesce((F.lit(dd_limit) - dd) / (abs(dd_limit) * cfg.margin_scale), F.lit(0.0))
    return hit, bound(0.5 + F.greatest(vol, fall) * 0.5)


def _way(above: float, below: float) -> Column:
    """Slope direction when a trend starts above ``above`` or below ``below``."""
    s = F.col("normalized_slope")
    return F.when(s > above, 1).when(s < below, -1).otherwise(0)


def proposals(df: DataFrame, cfg: MarketRegimeConfig) -> DataFrame:
    """Raw label and confidence for each class of previous label: up, down, neither, stressed.

    The moving-average cross decides when the slope does not, adds confidence when they agree and takes half
    of that away when they differ.
    """
    enter, leave = _stress(cfg, cfg.z_enter, cfg.dd_enter), _stress(cfg, cfg.z_exit, cfg.dd_exit)
    sure = 0.5 + F.abs("normalized_slope") / cfg.margin_scale * 0.5
    shared = {
        "_hit_in": enter[0], "_cs_in": enter[1], "_hit_out": leave[0], "_cs_out": leave[1],
        "_way0": _way(cfg.up_exit, cfg.down_enter),
        "_way1": _way(cfg.up_enter, cfg.down_exit),
        "_way2": _way(cfg.up_enter, cfg.down_enter),
        "_sure": F.when(F.col("normalized_slope").isNotNull(), F.least(F.lit(1.0), sure)).otherwise(0.5),
        "_flag": F.col("ma_flag") if cfg.use_ma_crossover else F.lit(0),
    }
    plus, minus = cfg.agreement_weight, cfg.agreement_weight * 0.5
    cols: dict[str, Column] = {}
    for k, (stress, way) in enumerate((("in", "_way0"), ("in", "_way1"), ("in", "_way2"), ("out", "_way2"))):
        bonus = f"case when _flag = 0 or {way} = 0 then 0d when {way} = _flag then {plus!r}d else -{minus!r}d end"
        turn = f"case when {way} = 0 then _flag else {way} end"
        calm = f"case {turn} when 1 then {UP} when -1 then {DOWN} else {CHOPPY} end"
        cols[f"raw_{k}"] = F.expr(f"case when _hit_{stress} then {STRESSED} else {calm} end")
        trend = f"least(1d, greatest(0d, _sure + {bonus}))"
        cols[f"conf_{k}"] = F.expr(f"case when _hit_{stress} then _cs_{stress} else {trend} end")
    return df.withColumns(shared).withColumns(cols).drop(*shared)


def machine(cfg: MarketRegimeConfig) -> hy.Machine:
    return hy.Machine(RAW, (UP, DOWN, CHOPPY, STRESSED), CHOPPY, 4, cfg.min_duration, cfg.confidence_gate)


def market_regime(
    feats: DataFrame,
    cfg: MarketRegimeConfig = MarketRegimeConfig(),
    by: str | list[str] = "symbol",
    mode: str = "live",
    rows: int = sg.SEGMENT_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Label, confidence and scores per row of :func:`market_features` (or of :func:`asof_features`).

    ``live`` tolerates missing features and reports calm_range with confidence 0 until the key has enough
    bars. ``batch`` waits for the full history and reports NULL on rows with a missing feature.
    """
    if mode not in ("live", "batch"):
        raise ValueError(f"mode must be 'live' or 'batch', got {mode}")
    by = sg.as_list(by)
    if mode == "live":
        skip = F.coalesce(F.col("n") < cfg.min_live_bars, F.lit(True))
    else:
        known = F.col("z_vol").isNotNull() & F.col("max_dd").isNotNull() & F.col("normalized_slope").isNotNull()
        skip = (F.col("n") < cfg.min_batch_rows) | ~known
    keep = [*by, "date", "n", "rv20_log", "z_vol", "max_dd", "normalized_slope", "ma_flag"]
    d = proposals(feats.select(*keep), cfg).withColumn("skip", skip)
    d = hy.run(d, machine(cfg), by, rows=rows, longest=longest)
    idle = F.lit("calm_range") if mode == "live" else F.lit(None).cast("string")
    idle_conf = F.lit(0.0) if mode == "live" else F.lit(None).cast("double")
    skipped = F.col("label").isNull()
    return d.select(
        *by,
        "date",
        F.when(skipped, idle).otherwise(public_label(F.col("label"))).alias("label"),
        F.when(skipped, idle_conf).otherwise(F.col("confidence")).alias("confidence"),
        F.when(
            ~skipped,
            F.struct(
                F.col("rv20_log").alias("rv20"),
                "z_vol",
                "max_dd",
                "normalized_slope",
                F.col("ma_flag").alias("ma_trend_flag"),
                F.col("raw_label").alias("raw_regime"),
                "raw_confidence",
                "days_in_regime",
                F.col("regime_start").alias("regime_start_date"),
            ),
        ).alias("scores"),
    )


def asof_features(feats: DataFrame, cal: DataFrame, start=None) -> DataFrame:
    """Benchmark features on every trading date from ``start``: the state of its last bar is carried."""
    from barframe.operators.panel import panel

    names = ["rv20_log", "z_vol", "max_dd", "normalized_slope", "ma_flag"]
    return panel(feats, cal, names, start=start)
