"""Registered queries: portfolio construction and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe import demo
from barframe.config import EvaluationConfig, PortfolioConstraints
from barframe.operators import alpha as al
from barframe.operators import performance as pf
from barframe.operators import portfolio as po
from barframe.operators import stock_regime as sr
from barframe.plans.evaluate import Evaluation, Parts, evaluate
from workload import inputs as inp
from workload import sql as q
from workload import sql_books as qb  # noqa: F401  (adds the SQL steps)
from workload.queries import add, longs, rounded

TOP = PortfolioConstraints(max_positions=10, min_positions=5, max_weight=0.15)
QUANTILE = PortfolioConstraints(max_positions=8, min_positions=5, max_weight=0.12, selection_mode="top_quantile", top_quantile=0.4)
FULL = PortfolioConstraints(max_positions=8, min_positions=5, max_weight=0.12, selection_mode="top_quantile", top_quantile=0.4, allow_cash=False)
FLOORED = PortfolioConstraints(max_positions=10, min_positions=5, max_weight=0.15, min_weight=0.08)
BANDED = PortfolioConstraints(max_positions=10, min_positions=5, max_weight=0.15, rebalance_band=0.02)
LIMITED = PortfolioConstraints(max_positions=10, min_positions=5, max_weight=0.15, turnover_limit=0.313701593871)
K = ("portfolio_id", "date")


def scores(s: SparkSession, d: str) -> DataFrame:
    build = lambda: al.ensemble(inp.feats(s, d), inp.market_rule(s, d), inp.stock_rule(s, d)).select(
        F.lit("main").alias("portfolio_id"), "date", "symbol", "score"
    )
    return inp.once(s, d, "scores", build)


def picked(s: SparkSession, d: str, cons: PortfolioConstraints = TOP) -> DataFrame:
    return po.select_positions(po.candidates(scores(s, d), cons), cons)


def raw(s: SparkSession, d: str, cons: PortfolioConstraints = TOP) -> DataFrame:
    return po.raw_weights(picked(s, d, cons), cons)


def held(s: SparkSession, d: str) -> DataFrame:
    return inp.once(s, d, "weights", lambda: po.target_weights(scores(s, d), TOP))


def before(s: SparkSession, d: str) -> DataFrame:
    """Weights of the trading date before, under this date."""
    c = inp.cal(s, d).select("date", "next_trading_date").filter(F.col("next_trading_date").isNotNull())
    return held(s, d).join(c, "date").select("portfolio_id", F.col("next_trading_date").alias("date"), "symbol", "weight")


def w(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df.select(*K, "symbol", "weight"), digits)


def wsql(step: str, digits: int = 6) -> str:
    return q.build(f"SELECT portfolio_id, date, symbol, round(weight, {digits}) + 0e0 AS weight FROM {step}", step)


def _universe(s: SparkSession, d: str) -> DataFrame:
    p = demo.table(s, d, "part")
    return p.groupBy(F.col("p_brand").alias("symbol")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 80)


_UNI = "SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 80"
add("portfolio_candidates", "P1 J4", lambda s, d: rounded(po.candidates(scores(s, d), PortfolioConstraints(score_floor=0.5), _universe(s, d))),
    q.build(f"SELECT portfolio_id, date, symbol, round(score, 6) AS score FROM book WHERE score > 5e-1 AND symbol IN ({_UNI})", "book"))


def _risk(s: SparkSession, d: str) -> DataFrame:
    return demo.table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg((F.avg("p_size") / 25.0).alias("multiplier")).filter(
        F.col("multiplier") < 1.2)


add("portfolio_risk", "P2", lambda s, d: rounded(po.apply_risk(po.candidates(scores(s, d), TOP), _risk(s, d), TOP, ["symbol"])),
    q.build("""SELECT portfolio_id, date, b.symbol, round(score * coalesce(least(1e0, greatest(0e0, m)), 1e0), 6) AS score FROM book b LEFT JOIN
      (SELECT p_brand AS symbol, avg(p_size) / 25e0 AS m FROM part GROUP BY 1 HAVING avg(p_size) / 25e0 < 12e-1) x ON x.symbol = b.symbol""", "book"))
add("select_top_n", "P3 R2", lambda s, d: rounded(longs(picked(s, d), "position")),
    q.build("SELECT portfolio_id, date, symbol, round(score, 6) AS score, position FROM top10", "top10"))
add("select_quantile", "P4", lambda s, d: rounded(longs(picked(s, d, QUANTILE), "position")),
    q.build("SELECT portfolio_id, date, symbol, round(score, 6) AS score, position FROM topq", "topq"))
add("raw_weights", "P5", lambda s, d: w(raw(s, d)), wsql("w_raw"))
add("cap_weights", "P6", lambda s, d: w(po.cap_weights(raw(s, d), 0.15)), wsql("w_cap"))
add("full_investment", "P7", lambda s, d: w(po.apply_max_weight(raw(s, d, FULL), FULL)), wsql("w_fill"))
add("minimum_weight", "P8", lambda s, d: w(po.target_weights(scores(s, d), FLOORED)), wsql("w_min"))
add("target_weights", "P13 U3", lambda s, d: w(po.target_weights(scores(s, d), TOP)), wsql("w_cap"))
add("rebalance_band", "P9 J6", lambda s, d: w(po.apply_band(held(s, d), before(s, d), BANDED)), wsql("w_band"))
add("turnover_limit", "P10 J6", lambda s, d: w(po.apply_turnover_limit(held(s, d), before(s, d), LIMITED), 9), wsql("w_lim", 9))
add("turnover", "P11 J6", lambda s, d: rounded(po.turnover(held(s, d), before(s, d))),
    q.build("SELECT portfolio_id, date, round(sum(abs(w_new - w_old)), 6) + 0e0 AS turnover FROM w_both GROUP BY 1, 2", "w_both"))


def _diag(s: SparkSession, d: str) -> DataFrame:
    n = po.candidates(scores(s, d), TOP).groupBy(*K).agg(F.count(F.lit(1)).alias("candidates"))
    return rounded(po.diagnostics(held(s, d), n, TOP, po.turnover(held(s, d), before(s, d))))


add("portfolio_diagnostics", "P12", _diag,
    q.build("""SELECT c.portfolio_id, c.date, c.candidates, h.selected, round(h.gross, 6) AS gross, c.candidates - h.selected AS dropped, 1e0 AS gross_target,
      round(greatest(0e0, 1e0 - h.gross), 6) + 0e0 AS cash_weight, round(t.turnover, 6) + 0e0 AS turnover
      FROM (SELECT portfolio_id, date, count(*) AS candidates FROM book GROUP BY 1, 2) c
      JOIN (SELECT portfolio_id, date, count(*) FILTER (weight > 0) AS selected, sum(weight) AS gross FROM w_cap GROUP BY 1, 2) h USING (portfolio_id, date)
      LEFT JOIN (SELECT portfolio_id, date, sum(abs(w_new - w_old)) AS turnover FROM w_both GROUP BY 1, 2) t USING (portfolio_id, date)""", "book", "w_cap", "w_both"))
add("portfolio_views", "P14",
    lambda s, d: rounded(po.views(held(s, d)).withColumn("symbols", F.size("symbols").cast("long"))),
    q.build("""SELECT portfolio_id, date, count(*) FILTER (weight > 0) AS n_positions, round(max(weight), 6) AS max_weight, round(sum(weight), 6) AS gross,
      round(greatest(0e0, 1e0 - sum(weight)), 6) + 0e0 AS cash, count(*) FILTER (weight > 0) AS symbols FROM w_cap GROUP BY 1, 2""", "w_cap"))


def _hedged(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.col("weight") - 0.06)


add("clip_long_only", "P15 U4", lambda s, d: w(po.clip_long_only(_hedged(held(s, d)))),
    q.build("SELECT portfolio_id, date, symbol, round(weight - 6e-2, 6) + 0e0 AS weight FROM w_cap WHERE weight - 6e-2 > 0", "w_cap"))


def _members(s: SparkSession, d: str) -> DataFrame:
    return demo.table(s, d, "part").select(F.col("p_type").alias("portfolio_id"), F.col("p_brand").alias("symbol"))


add("universe_cap", "P16", lambda s, d: po.universe_cap(_members(s, d)),
    """SELECT p_type AS portfolio_id, count(DISTINCT p_brand) AS n_symbols, least(25e-2, greatest(5e-2, round(2e0 / count(DISTINCT p_brand), 4))) AS max_weight,
      least(50, count(DISTINCT p_brand)) AS max_positions, least(5, count(DISTINCT p_brand)) AS min_positions FROM part GROUP BY 1""")


def _trades(s: SparkSession, d: str) -> DataFrame:
    price = demo.quotes(s, d).select("symbol", F.col("last").alias("price"))
    t = po.trades(held(s, d), before(s, d), price, 100_000.0)
    return rounded(t.filter(F.abs("delta") > 1e-9))


_LAST = "(SELECT symbol, arg_max(close, date) AS price FROM bars GROUP BY 1)"
add("weights_to_trades", "P17 J6", _trades,
    q.build(f"""SELECT portfolio_id, date, symbol, CASE WHEN w_new > w_old THEN 'BUY' ELSE 'SELL' END AS side,
      round(abs((w_new - w_old) * 1e5 / price), 6) + 0e0 AS qty, round(w_new - w_old, 6) + 0e0 AS delta FROM w_both JOIN {_LAST} USING (symbol)
      WHERE abs(w_new - w_old) > 1e-9""", "w_both", "bars"))


def _dates(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).select("portfolio_id", "date").distinct()


def _paths(s: SparkSession, d: str) -> DataFrame:
    """Band and limit settings as portfolios of their own."""
    t, days = held(s, d), _dates(s, d)
    out = None
    for name, cons in (("banded", BANDED), ("limited", LIMITED)):
        own = lambda df, n=name: df.withColumn("portfolio_id", F.lit(n))
        p = po.rebalance_path(own(t), own(days), cons)
        out = p if out is None else out.unionByName(p)
    return w(out)


add("rebalance_path", "P9 P10", _paths,
    q.build("SELECT portfolio_id, date, symbol, round(weight, 6) AS weight FROM banded UNION ALL SELECT portfolio_id, date, symbol, round(weight, 6) AS weight FROM limited", "banded", "limited"))

# --- evaluation --------------------------------------------------------------------------------------------


def _daily(s: SparkSession, d: str) -> DataFrame:
    return pf.daily_returns(held(s, d), pf.bar_returns(inp.feats(s, d)), inp.cal(s, d))


def _nav(s: SparkSession, d: str) -> DataFrame:
    return inp.once(s, d, "nav", lambda: pf.nav(_daily(s, d), _dates(s, d), inp.cal(s, d)))


add("portfolio_returns", "V2 J8", lambda s, d: rounded(_daily(s, d)),
    q.build("SELECT portfolio_id, date, round(ret, 6) + 0e0 AS ret FROM rule_ret", "rule_ret"))
add("equity_curve", "V2 V3 W10", lambda s, d: rounded(pf.equity_path(_nav(s, d)).drop("peak", "ret"), 5),
    q.build("""SELECT portfolio_id, date, round(nav, 5) AS nav, round(change, 5) + 0e0 AS change, round(nav / peak - 1, 5) + 0e0 AS drawdown FROM rule_path""", "rule_path"))


def _stats(df: DataFrame) -> DataFrame:
    fine = {c: F.round(c, 4) for c in ("initial_value", "final_value")}
    return longs(rounded(df).withColumns(fine), "n_trading_days", "n_rebalances")


add("performance_stats", "V6", lambda s, d: _stats(pf.perf_stats(_nav(s, d), held(s, d), _dates(s, d))),
    q.build(qb.stats("rule", "w_cap", "rule_dates"), "rule_path", "w_cap", "rule_dates"))
_SYM = [f"Brand#{k}" for k in range(1, 26)]  # all symbols of the tables
add("weights_matrix", "V4 B10", lambda s, d: rounded(pf.weights_matrix(held(s, d), _SYM)),
    q.build("SELECT portfolio_id, date, " + ", ".join(f"""round(coalesce(sum(CASE WHEN symbol = '{x}' THEN weight END), 0e0), 6) AS "{x}" """ for x in _SYM)
            + " FROM w_cap GROUP BY 1, 2", "w_cap"))
add("last_portfolio", "V7", lambda s, d: w(pf.last_portfolio(held(s, d))),
    q.build("SELECT portfolio_id, date, symbol, round(weight, 6) AS weight FROM w_cap WHERE date = (SELECT max(date) FROM w_cap)", "w_cap"))
add("regime_share", "V5", lambda s, d: rounded(pf.label_share(inp.market_states(s, d))),
    q.build("SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM market GROUP BY 1", "market"))


def run(s: SparkSession, d: str, cfg: EvaluationConfig = EvaluationConfig()) -> Evaluation:
    return evaluate(inp.all_bars(s, d), demo.BENCHMARK, cfg)


add("evaluate_weights", "V1 V8", lambda s, d: w(run(s, d).weights), wsql("run_weights"))
add("evaluate_equity", "V1 V3", lambda s, d: rounded(run(s, d).nav.select("portfolio_id", "date", "nav"), 5),
    q.build("SELECT portfolio_id, date, round(nav, 5) AS nav FROM run_nav", "run_nav"))
add("evaluate_stats", "V1 V6", lambda s, d: _stats(run(s, d).stats),
    q.build(qb.stats("run", "run_weights", "run_dates"), "run_path", "run_weights", "run_dates"))
add("evaluate_regimes", "V1 V5", lambda s, d: rounded(run(s, d).market_regime.select("date", "label", "confidence")),
    q.build("SELECT date, label, round(confidence, 6) + 0e0 AS confidence FROM run_market", "run_market"))


def _own_detector(s: SparkSession, d: str) -> DataFrame:
    """A detector given from outside; here it gives the built-in labels, so the weights must be the same."""
    detect = lambda grid, market: sr.stock_regime(grid, market).select("symbol", "date", "label", "confidence")
    return w(evaluate(inp.all_bars(s, d), demo.BENCHMARK, parts=Parts(detector=detect)).weights)


add("evaluate_own_detector", "U2 V8", _own_detector, wsql("run_weights"))


def _sweep(s: SparkSession, d: str) -> DataFrame:
    books = {"plain": TOP, "banded": BANDED, "limited": LIMITED, "quantile": QUANTILE}
    ev = evaluate(inp.all_bars(s, d), demo.BENCHMARK, portfolios=books)
    return _stats(ev.stats)


add("evaluate_sweep", "V1 P9 P10", _sweep, qb.sweep())
