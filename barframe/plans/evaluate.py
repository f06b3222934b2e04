"""From bars to equity: features, regimes, alpha, weights, returns and statistics as one chain of tables.

The panel is shuffled twice: by symbol for the rolling features and regimes, by date for the ranks. Tables
read more than once are settled, which also lets Catalyst broadcast the per-date ones by their real size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.config import EvaluationConfig, PortfolioConstraints
from barframe.operators import alpha as al
from barframe.operators import features as ft
from barframe.operators import market_regime as mr
from barframe.operators import panel as pn
from barframe.operators import performance as pf
from barframe.operators import portfolio as po
from barframe.operators import stock_regime as sr
from barframe.plans.settle import settle
from barframe.sources.universe import split_benchmark

ALPHA_INPUTS = ("mom63", "dev20", "rv20_z", "rv60", "rv20")
NEEDED = sorted({*ALPHA_INPUTS, *sr.INPUTS, "ret1"})
Overlay = Callable[[DataFrame], DataFrame]
Detector = Callable[[DataFrame, DataFrame], DataFrame]
Constructor = Callable[[DataFrame, PortfolioConstraints], DataFrame]


@dataclass(frozen=True)
class Parts:
    """Replaceable parts of the strategy; each is a function over DataFrames.

    ``detector(panel, market)`` gives ``symbol, date, label, confidence``. ``models`` are further alpha models
    (see :func:`alpha.run_models`), blended only if the ensemble weights list them.
    ``constructor(scores, constraints)`` gives ``portfolio_id, date, symbol, weight``.
    """

    detector: Detector | None = None
    models: dict[str, al.AlphaModel] | None = None
    constructor: Constructor | None = None


@dataclass(frozen=True)
class Evaluation:
    calendar: DataFrame
    rebalances: DataFrame
    features: DataFrame
    market_regime: DataFrame
    stock_regime: DataFrame
    alpha: DataFrame
    weights: DataFrame
    nav: DataFrame
    stats: DataFrame
    constraints: PortfolioConstraints


def market_on(bench: DataFrame, cal: DataFrame, ready, cfg: EvaluationConfig, n_dates: int) -> DataFrame:
    """Market regime on every trading date from ``ready``; the defaults when there is no benchmark."""
    feats = mr.market_features(bench, cfg.market, longest=n_dates)
    seen = mr.asof_features(feats, cal, start=ready)
    live = cal.filter(F.col("date") >= F.lit(ready)).select("date")
    labels = mr.market_regime(seen, cfg.market, longest=n_dates).drop("symbol")
    d = live.join(labels, "date", "left")
    return d.withColumns(
        {"label": F.coalesce("label", F.lit("calm_range")), "confidence": F.coalesce("confidence", F.lit(0.0))}
    )


def scores_of(grid: DataFrame, market: DataFrame, cfg: EvaluationConfig, parts: Parts, n_dates: int, n_symbols: int):
    """(stock regimes, ranked scores) of the panel ``grid``."""
    if parts.detector is None:
        stock = settle(sr.stock_regime(grid, market, cfg.stock, longest=n_dates, carry=ALPHA_INPUTS), "stock-regime")
        wide = stock.withColumnsRenamed({"label": "stock_label", "confidence": "stock_conf"}).join(
            market.select("date", F.col("label").alias("market_label")), "date"
        )
    else:
        grid = settle(grid, "panel")
        stock = settle(parts.detector(grid, market), "stock-regime")
        wide = al.with_regimes(grid.select("symbol", "date", *ALPHA_INPUTS), market, stock)
    if parts.models:
        wide = settle(wide, "panel")
        long = al.weighted(al.run_models(wide, parts.models), market, cfg.alpha)
        routed = al.route(long, market, stock, cfg.alpha.router).withColumnRenamed("score", "combined_score")
        return stock, al.finish(routed, cfg.alpha, largest=n_symbols)
    routed = al.combine(al.score_models(wide), cfg.alpha)
    return stock, al.finish(routed, cfg.alpha, keep_parts=True, largest=n_symbols)


def signals_on(bars: DataFrame, benchmark: str, cfg: EvaluationConfig, universe: DataFrame | None, parts: Parts,
               catalogue: ft.Catalogue | None = None):
    """Everything up to the ranked scores, as settled tables."""
    traded, bench = split_benchmark(bars, benchmark, universe)
    cal = settle(pn.calendar(traded.unionByName(bench)), "calendar")
    n_dates = cal.count()  # a symbol has at most one bar per date, which bounds every per-symbol window
    feats = settle(ft.features(traded, NEEDED, keep=("close",), catalogue=catalogue, longest=n_dates), "features")
    ready = pn.ready_date(feats, cfg.warmup_bars, cfg.readiness_threshold).first()["ready_date"]
    if ready is None:
        raise ValueError("no date has enough bars: the universe never becomes ready")
    market = settle(market_on(bench, cal, ready, cfg, n_dates), "market-regime")
    grid = pn.panel(feats, cal, NEEDED, start=ready)
    n_symbols = feats.filter(F.col("n") == 1).count()
    stock, scores = scores_of(grid, market, cfg, parts, n_dates, n_symbols)
    return cal, feats, ready, market, stock, settle(scores, "alpha"), n_symbols


def evaluate(
    bars: DataFrame,
    benchmark: str = "SPY",
    cfg: EvaluationConfig = EvaluationConfig(),
    universe: DataFrame | None = None,
    portfolios: dict[str, PortfolioConstraints] | None = None,
    overlay: Overlay | None = None,
    parts: Parts = Parts(),
    account_overlay: Overlay | None = None,
    risk: DataFrame | None = None,
    catalogue: ft.Catalogue | None = None,
) -> Evaluation:
    """Evaluate the regime-routed long-only strategy on ``bars`` (symbol, date, close, volume).

    ``portfolios`` evaluates several settings side by side. ``overlay`` (of the strategy), then ``account_overlay``
    adjust target weights, each before a long-only clip. ``risk`` (symbol, optionally date, multiplier) scales scores.
    ``catalogue`` defines the features under the names the strategy reads. ``parts`` swaps the detector, adds models or replaces the constructor. Weights of
    a date use closes up to that date and earn from the next one.
    """
    cal, feats, ready, market, stock, scores, n_symbols = signals_on(bars, benchmark, cfg, universe, parts, catalogue)
    if portfolios is None:
        cons = cfg.constraints
        if cons is None:
            cons = PortfolioConstraints.for_universe(n_symbols)
        portfolios = {"main": cons}
    days = cal.filter(F.col("date") >= F.lit(ready)).select("date")

    books, plans = [], []
    for name, cons in portfolios.items():
        own = scores.select(F.lit(name).alias("portfolio_id"), "date", "symbol", "score")
        dates = days.select(F.lit(name).alias("portfolio_id"), "date")
        build = parts.constructor or po.target_weights
        if risk is not None:
            own = po.apply_risk(own, risk, cons)
        w = build(own, cons).select("portfolio_id", "date", "symbol", "weight")
        if cons.path_dependent:
            w = po.rebalance_path(w, dates, cons)
        for adjust in (overlay, account_overlay):
            if adjust is not None:
                w = po.clip_long_only(adjust(w)).select("portfolio_id", "date", "symbol", "weight")
        books.append(w)
        plans.append(dates)
    weights = books[0]
    rebalances = plans[0]
    for w, d in zip(books[1:], plans[1:]):
        weights, rebalances = weights.unionByName(w), rebalances.unionByName(d)
    weights = settle(weights, "weights")

    daily = pf.daily_returns(weights, pf.bar_returns(feats), cal)
    span = cal.filter(F.col("date") >= F.lit(ready)) if cfg.from_first_trade else cal
    equity = settle(pf.nav(daily, rebalances, span, cfg.initial_cash), "nav")
    stats = pf.perf_stats(equity, weights, rebalances)
    first = next(iter(portfolios.values()))
    return Evaluation(cal, rebalances, feats, market, stock, scores, weights, equity, stats, first)
