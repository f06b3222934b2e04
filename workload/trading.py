"""Registered queries: inventory, order analytics, learning and streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe import demo
from barframe.config import CommissionConfig, FillConfig, RiskLimits, SlippageConfig, StockRegimeConfig
from barframe.operators import features as ft
from barframe.operators import hysteresis as hy
from barframe.operators import inventory as iv
from barframe.operators import learning as ln
from barframe.operators import orders as od
from barframe.operators import stock_regime as sr
from barframe.plans.settle import new_path, settle
from barframe.sources import bars as sb
from barframe.streaming import incremental as ic
from barframe.streaming import regimes as rg
from barframe.streaming import sources as so
from barframe.streaming import timers as tm
from barframe.streaming.state import rocksdb
from workload import inputs as inp
from workload import sql as q
from workload import sql_learning as sl
from workload.queries import add, longs, r, rounded

# --- inventory ---------------------------------------------------------------------------------------------


def _held(s: SparkSession, d: str) -> DataFrame:
    """Bars up to a date that depends on the brand, so some symbols are stale and some absent."""
    cut = F.expr("date_add(date'2001-11-05', -3 * cast(regexp_extract(symbol, '#([0-9]+)$', 1) as int))")
    return inp.bars(s, d).filter((F.col("date") <= cut) & ~F.col("symbol").endswith("3"))


_CUT = "date <= DATE '2001-11-05' - 3 * CAST(regexp_extract(symbol, '#([0-9]+)$', 1) AS INT) AND symbol NOT LIKE '%3'"
TODAY = "2001-11-07"
q.step("inv", f"""SELECT u.symbol, FALSE AS has_csv, n IS NOT NULL AS has_parquet, coalesce(n, 0) AS n_rows, first_date, last_date,
  coalesce((SELECT count(*) FROM unnest(generate_series(last_date + 1, DATE '{TODAY}', INTERVAL 1 DAY)) AS t(x) WHERE isodow(x) < 6), 0) AS days_stale,
  n IS NOT NULL AS present
  FROM (SELECT DISTINCT p_brand AS symbol FROM part) u LEFT JOIN (SELECT symbol, count(*) AS n, min(date) AS first_date, max(date) AS last_date
    FROM bars WHERE {_CUT} GROUP BY 1) b USING (symbol)""", "bars")
I = lambda s, d: iv.inventory(_held(s, d), demo.universe(s, d), TODAY)  # noqa: E731,E741
add("inventory", "N1 N2 J5", I, q.build("SELECT *, days_stale > 1 AS is_stale FROM inv", "inv"))
add("inventory_missing", "N3", lambda s, d: iv.missing(I(s, d)), q.build("SELECT symbol FROM inv WHERE NOT present", "inv"))
add("inventory_present", "N3", lambda s, d: iv.present(I(s, d)), q.build("SELECT symbol FROM inv WHERE present", "inv"))
add("inventory_stale", "N3", lambda s, d: iv.stale(I(s, d), 5), q.build("SELECT symbol FROM inv WHERE days_stale > 5", "inv"))
add("inventory_status", "N4", lambda s, d: iv.status(I(s, d)),
    q.build("""SELECT count(*) AS n_symbols, count(*) FILTER (present) AS present, count(*) FILTER (NOT present) AS missing,
      count(*) FILTER (days_stale > 1) AS stale FROM inv""", "inv"))
add("inventory_table", "N4", lambda s, d: iv.status_table(I(s, d)),
    q.build("""SELECT symbol, CASE WHEN NOT present THEN 'MISSING' WHEN days_stale > 1 THEN 'STALE' ELSE 'ok' END AS status, n_rows,
      coalesce(strftime(first_date, '%Y-%m-%d'), '-') AS first, coalesce(strftime(last_date, '%Y-%m-%d'), '-') AS last,
      CASE WHEN days_stale > 0 THEN days_stale || 'd' ELSE '-' END AS age FROM inv""", "inv"))
_PLAN = f"""SELECT symbol, CASE WHEN (present AND days_stale <= 1) OR (present AND last_date + 1 > DATE '{TODAY}') THEN 'skip' WHEN present THEN 'update' ELSE 'new' END AS action,
  CASE WHEN NOT (present AND days_stale <= 1) THEN CASE WHEN present THEN last_date + 1 ELSE DATE '1970-01-01' END END AS start,
  CASE WHEN NOT (present AND days_stale <= 1) THEN DATE '{TODAY}' END AS "end" FROM inv"""
add("sync_plan", "N5", lambda s, d: iv.sync_plan(I(s, d), TODAY), q.build(_PLAN, "inv"))
add("sync_report", "N6", lambda s, d: iv.sync_report(iv.sync_plan(I(s, d), TODAY)), q.build(f"SELECT action, count(*) AS n FROM ({_PLAN}) GROUP BY 1", "inv"))
add("last_date", "N7", lambda s, d: sb.last_date(inp.bars(s, d)), q.build("SELECT max(date) AS last_date FROM bars", "bars"))
add("sorted_bars", "R1", lambda s, d: inp.bars(s, d).select("symbol", "date", "close").orderBy("symbol", "date"),
    q.build("SELECT symbol, date, close FROM bars ORDER BY symbol, date", "bars"))

# --- orders ------------------------------------------------------------------------------------------------
BPS = SlippageConfig("bps", 3.0)
PER_SHARE = CommissionConfig("per_share", per_share=0.011, min_commission=0.37)
FIXED = CommissionConfig("fixed_per_order", fixed_per_order=1.25, min_commission=0.5)
BRAND = "'Brand#' || CAST(({k} % 25) + 1 AS VARCHAR)"
q.step("orders_", f"""SELECT o_orderkey AS order_id, o_custkey AS account_id, CAST(o_orderdate AS TIMESTAMP) AS ts, {BRAND.format(k='o_orderkey')} AS symbol,
  CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, round(o_totalprice / 5e3, 0) AS qty,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'LIMIT' ELSE 'MARKET' END AS order_type,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(80 + o_orderkey % 41 AS DOUBLE) END AS limit_price,
  CASE o_orderstatus WHEN 'O' THEN 'ACCEPTED' WHEN 'P' THEN 'PARTIALLY_FILLED' ELSE 'FILLED' END AS status FROM orders""")
q.step("quotes", """SELECT symbol, round(q.close * 999e-3, 4) AS bid, round(q.close * 1001e-3, 4) AS ask, q.close AS last, q.high AS high, q.low AS low
  FROM (SELECT symbol, arg_max({'close': close, 'high': high, 'low': low}, date) AS q FROM bars GROUP BY 1)""", "bars")
q.step("fills", f"""SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS fill_id, l_orderkey AS order_id, l_orderkey % 50 AS account_id,
  CAST(x.d AS TIMESTAMP) AS ts, {BRAND.format(k='l_orderkey')} AS symbol, CASE WHEN l_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side,
  x.q AS qty, round(x.p / x.q, 8) AS price, round(x.t * 10, 2) AS fee FROM (
    SELECT l_orderkey, l_linenumber, min({{'d': l_shipdate, 'q': l_quantity, 'p': l_extendedprice, 't': l_tax, 's': l_suppkey}}) AS x
    FROM lineitem GROUP BY 1, 2)""")
add("order_costs", "O1 O2",
    lambda s, d: rounded(demo.fills(s, d).select("fill_id", od.commission(F.col("qty")).alias("none"), od.commission(F.col("qty"), FIXED).alias("fixed"),
                                                 od.commission(F.col("qty"), PER_SHARE).alias("per_share"), od.slippage(F.col("price"), BPS).alias("slip"))),
    q.build("""SELECT fill_id, 0e0 AS none, 125e-2 AS fixed, round(greatest(abs(qty) * 11e-3, 37e-2), 6) AS per_share, round(abs(price) * 3e-4, 12) AS slip FROM fills""", "fills"))


def _priced(s: SparkSession, d: str, rule: str = "touch") -> DataFrame:
    return od.price_orders(demo.orders(s, d), demo.quotes(s, d), FillConfig(limit_fill_rule=rule), BPS, PER_SHARE)


def _price_sql(low: str, high: str) -> str:
    return f"""SELECT o.*, CASE WHEN order_type = 'MARKET' THEN CASE WHEN side = 'BUY' THEN ask + (abs(ask) * 3e-4 + abs(ask) * 2e-4)
        ELSE bid - (abs(bid) * 3e-4 + abs(bid) * 2e-4) END
      WHEN side = 'BUY' AND {low} <= limit_price THEN limit_price WHEN side = 'SELL' AND {high} >= limit_price THEN limit_price END AS fill_price
      FROM orders_ o JOIN quotes USING (symbol)"""


q.step("priced", _price_sql("last", "last"), "orders_", "quotes")
q.step("priced_bar", _price_sql("low", "high"), "orders_", "quotes")
_PCOLS = "order_id, account_id, ts, symbol, side, qty, order_type, limit_price, status, round(fill_price, 6) AS fill_price, round(CASE WHEN fill_price IS NOT NULL THEN greatest(abs(qty) * 11e-3, 37e-2) END, 6) AS fee"
add("execution_price", "O3 O4 J9", lambda s, d: rounded(_priced(s, d)), q.build(f"SELECT {_PCOLS} FROM priced", "priced"))
add("execution_price_bar", "O4", lambda s, d: rounded(_priced(s, d, "bar_high_low")), q.build(f"SELECT {_PCOLS} FROM priced_bar", "priced_bar"))


def _parts(s: SparkSession, d: str) -> DataFrame:
    return od.split_fills(_priced(s, d), FillConfig(allow_partial_fills=True), PER_SHARE)


q.step("parts", """SELECT order_id || '-' || part AS fill_id, order_id, account_id, ts, symbol, side,
  CASE WHEN part = 1 THEN qty * 6e-1 ELSE qty - qty * 6e-1 END AS qty, fill_price AS price, part FROM priced, (SELECT unnest([1, 2]) AS part)
  WHERE fill_price IS NOT NULL AND qty > 0""", "priced")
add("partial_fills", "O6", lambda s, d: longs(rounded(_parts(s, d)), "part"),
    q.build("""SELECT fill_id, order_id, account_id, ts, symbol, side, round(qty, 6) AS qty, round(price, 6) AS price, round(greatest(abs(qty) * 11e-3, 37e-2), 6) AS fee,
      CAST(part AS BIGINT) AS part FROM parts""", "parts"))
# Averages that end on a half at the sixth digit are moved off it, or the order of a sum would decide.
add("fill_roll_up", "O5", lambda s, d: rounded(od.roll_up(demo.fills(s, d), demo.orders(s, d)).withColumn("avg_fill_price", F.col("avg_fill_price") + 1e-9)),
    q.build("""SELECT f.order_id, filled_qty, round(avg_fill_price + 1e-9, 6) AS avg_fill_price, round(fees, 6) AS fees, o.qty AS order_qty,
      CASE WHEN abs(filled_qty - o.qty) < 1e-9 THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END AS status FROM (
      SELECT order_id, sum(qty) AS filled_qty, sum(price * qty) / sum(qty) AS avg_fill_price, sum(fee) AS fees FROM fills GROUP BY 1) f JOIN orders_ o USING (order_id)""", "fills", "orders_"))
add("cash_ledger", "O7", lambda s, d: rounded(od.ledger(demo.fills(s, d)).select("fill_id", "account_id", "cash_change", "cash"), 3),
    q.build("""SELECT fill_id, account_id, round(c, 3) + 0e0 AS cash_change, round(sum(c) OVER (PARTITION BY account_id ORDER BY ts, fill_id) + 1e5, 3) + 0e0 AS cash FROM (
      SELECT *, CASE WHEN side = 'BUY' THEN -(qty * price + fee) ELSE qty * price - fee END AS c FROM fills)""", "fills"))
q.step("held", """SELECT account_id, symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS qty FROM fills GROUP BY 1, 2
  HAVING abs(sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END)) >= 1e-9""", "fills")
add("positions", "O8", lambda s, d: rounded(od.positions(demo.fills(s, d))), q.build("SELECT * FROM held", "held"))
add("position_path", "O8", lambda s, d: rounded(od.position_path(demo.fills(s, d)).select("fill_id", "account_id", "symbol", "position")),
    q.build("""SELECT fill_id, account_id, symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) OVER (PARTITION BY account_id, symbol ORDER BY ts, fill_id) AS position FROM fills""", "fills"))
add("open_orders", "O10", lambda s, d: od.open_orders(demo.orders(s, d)),
    q.build("SELECT account_id, count(*) FILTER (status IN ('ACCEPTED', 'PARTIALLY_FILLED')) AS open_orders FROM orders_ GROUP BY 1", "orders_"))


def _checked(s: SparkSession, d: str) -> DataFrame:
    limits = RiskLimits(max_notional_per_trade=6_000.0, max_position_notional=9_000.0, max_open_orders=9)
    new = demo.orders(s, d).select("order_id", (F.col("account_id") % 50).alias("account_id"), "symbol", "side", (F.col("qty") * 1.0137).alias("qty"), "status")
    counts = od.open_orders(demo.orders(s, d))
    small = od.positions(demo.fills(s, d)).withColumn("qty", F.col("qty") / 20.0)
    return rounded(od.risk_check(new, demo.quotes(s, d), demo.accounts(s, d), small, counts, limits), 9)


add("risk_check", "O9 J9", _checked,
    q.build("""SELECT order_id, account_id, symbol, side, round(qty, 9) AS qty, status, round(notional, 9) AS notional, round(new_qty, 9) + 0e0 AS new_qty, reason IS NULL AS accepted, reason AS reject_reason FROM (
      SELECT *, CASE WHEN coalesce(open_orders, 0) >= 9 THEN 'Too many open orders'
        WHEN notional > 6e3 THEN 'Trade notional ' || printf('%.2f', notional) || ' > max_notional_per_trade'
        WHEN side = 'BUY' AND cash - notional < 1e3 THEN 'Insufficient cash buffer' WHEN new_qty < 0 THEN 'Shorting not allowed'
        WHEN abs(new_qty * last) > 9e3 THEN 'Position limit exceeded' END AS reason FROM (
      SELECT o.order_id, o.account_id, o.symbol, o.side, o.qty, o.status, abs(o.qty * q.last) AS notional, q.last, c.open_orders, coalesce(a.cash, 0e0) AS cash,
        coalesce(h.qty / 2e1, 0e0) + CASE WHEN side = 'BUY' THEN o.qty ELSE -o.qty END AS new_qty
      FROM (SELECT * REPLACE (account_id % 50 AS account_id, qty * 10137e-4 AS qty) FROM orders_) o JOIN quotes q USING (symbol)
      LEFT JOIN (SELECT c_custkey AS account_id, c_acctbal * 10 AS cash FROM customer) a USING (account_id) LEFT JOIN held h ON h.account_id = o.account_id AND h.symbol = o.symbol
      LEFT JOIN (SELECT account_id, count(*) FILTER (status IN ('ACCEPTED', 'PARTIALLY_FILLED')) AS open_orders FROM orders_ GROUP BY 1) c ON c.account_id = o.account_id))""",
            "orders_", "quotes", "held"))
add("position_valuation", "O11",
    lambda s, d: rounded(od.valuation(od.positions(demo.fills(s, d)), od.average_cost(demo.fills(s, d)), demo.quotes(s, d)), 5),
    q.build("""SELECT h.account_id, h.symbol, h.qty, round(a.avg_price, 5) AS avg_price, round(q.last, 5) AS market_price, round(h.qty * q.last, 5) AS market_value,
      round(h.qty * (q.last - a.avg_price), 5) + 0e0 AS unrealized_pnl,
      round(CASE WHEN abs(h.qty * a.avg_price) > 0 THEN h.qty * (q.last - a.avg_price) / abs(h.qty * a.avg_price) * 1e2 END, 5) + 0e0 AS unrealized_pnl_pct,
      CASE WHEN h.qty < 0 THEN 'short' ELSE 'long' END AS side FROM held h
      LEFT JOIN (SELECT account_id, symbol, sum(qty * price) / sum(qty) AS avg_price FROM fills WHERE side = 'BUY' GROUP BY 1, 2) a USING (account_id, symbol)
      JOIN quotes q USING (symbol)""", "held", "fills", "quotes"))


def _reports(s: SparkSession, d: str) -> DataFrame:
    """Order lines as broker fill reports; repeated (order, line) pairs are repeated reports."""
    line = demo.table(s, d, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("broker_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("event_id"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_returnflag") == "R", "canceled").when(F.col("l_returnflag") == "A", "partially_filled").otherwise("filled").alias("status"))


def _ids(s: SparkSession, d: str) -> DataFrame:
    line = demo.table(s, d, "lineitem").filter(F.col("l_linenumber") <= 5)
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("broker_id"), F.col("l_orderkey").alias("order_id")).distinct()


def _seen(s: SparkSession, d: str) -> DataFrame:
    o = demo.table(s, d, "orders").filter(F.col("o_orderstatus") == "F")
    return o.select((F.col("o_orderkey") * 10 + 1).cast("long").alias("broker_id"))


add("dedupe_fills", "O12 J10",
    lambda s, d: od.dedupe_fills(_reports(s, d), _ids(s, d), _seen(s, d)).select("broker_id", "order_id", "ts", "event_id", "qty", "status"),
    """SELECT broker_id, order_id, ts, event_id, qty, status FROM (SELECT *, row_number() OVER (PARTITION BY broker_id ORDER BY ts, event_id) AS k FROM (
      SELECT l_orderkey * 10 + l_linenumber AS broker_id, l_orderkey AS order_id, CAST(l_shipdate AS TIMESTAMP) AS ts, l_partkey * 1000 + l_suppkey AS event_id,
        l_quantity AS qty, CASE l_returnflag WHEN 'A' THEN 'partially_filled' ELSE 'filled' END AS status FROM lineitem WHERE l_linenumber <= 5 AND l_returnflag <> 'R' AND l_quantity > 0)
      WHERE broker_id NOT IN (SELECT o_orderkey * 10 + 1 FROM orders WHERE o_orderstatus = 'F')) WHERE k = 1""")
add("merge_orders", "O13",
    lambda s, d: od.merge_orders(demo.orders(s, d).filter(F.col("status") != "FILLED").select("order_id", "symbol", "status"),
                                 demo.fills(s, d).groupBy("order_id", "symbol").agg(F.lit("filled").alias("status"))),
    q.build("""SELECT order_id, symbol, status FROM orders_ WHERE status <> 'FILLED' UNION ALL SELECT DISTINCT order_id, symbol, 'filled' FROM fills
      WHERE order_id NOT IN (SELECT order_id FROM orders_ WHERE status <> 'FILLED')""", "orders_", "fills"))
add("latest_state", "O14",
    lambda s, d: od.latest_state(demo.table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "user_id", ["ts", "event_id"]),
    """SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
add("recent_fills", "O14 R4", lambda s, d: longs(od.fill_ids_by_order(demo.fills(s, d), 3).select("order_id", "fill_id", "position"), "position"),
    q.build("SELECT * FROM (SELECT order_id, fill_id, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, fill_id DESC) AS position FROM fills) WHERE position <= 3", "fills"))

# --- learning ----------------------------------------------------------------------------------------------
COLS = ["ret1", "mom5", "mom21", "rv20", "dev20"]
F4 = dict(train=1000, test=250, gap=5)


def _table(s: SparkSession, d: str, mode: str = "forward") -> DataFrame:
    return inp.once(s, d, f"training-{mode}", lambda: ln.training_table(inp.feats(s, d), COLS, ("symbol", "date", "close"), mode))


_LABEL = """SELECT symbol, date, close, {fwd} AS ret_fwd_1, ret1, mom5, mom21, rv20, dev20 FROM (
  SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS nx FROM feats)"""
_OK = " AND ".join(f"{c} IS NOT NULL" for c in COLS)
q.step("train", f"SELECT *, CASE WHEN ret_fwd_1 > 0 THEN 1 ELSE 0 END AS y FROM ({_LABEL.format(fwd='nx / close - 1')}) WHERE ret_fwd_1 IS NOT NULL AND {_OK}", "feats")
q.step("train_compat", f"SELECT *, CASE WHEN ret_fwd_1 > 0 THEN 1 ELSE 0 END AS y FROM ({_LABEL.format(fwd='close / nx - 1')}) WHERE {_OK}", "feats")
add("next_day_label", "L1 L3", lambda s, d: longs(rounded(_table(s, d).select("symbol", "date", "ret_fwd_1", "y")), "y"),
    q.build(f"SELECT symbol, date, {r('ret_fwd_1')}, CAST(y AS BIGINT) AS y FROM train", "train"))
add("next_day_label_compat", "L1 L3", lambda s, d: longs(rounded(_table(s, d, "compat").select("symbol", "date", "ret_fwd_1", "y")), "y"),
    q.build(f"SELECT symbol, date, {r('ret_fwd_1')}, CAST(y AS BIGINT) AS y FROM train_compat", "train_compat"))


def _folds(s: SparkSession, d: str, anchored: bool = True) -> DataFrame:
    return inp.once(s, d, f"folds-{anchored}", lambda: ln.walk_forward(_table(s, d), anchored=anchored, **F4))


def _fold_sql(first: str) -> str:
    return f"""SELECT f + 1 AS fold, a.date AS train_start, b.date AS train_end, c.date AS test_start, e.date AS test_end
      FROM (SELECT unnest(range(0, CAST(((SELECT count(*) FROM days) - 1255) // 250 + 1 AS BIGINT))) AS f)
      JOIN days a ON a.i = {first} JOIN days b ON b.i = f * 250 + 999 JOIN days c ON c.i = f * 250 + 1005 JOIN days e ON e.i = f * 250 + 1254"""


q.step("days", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM train)", "train")
q.step("folds", _fold_sql("0"), "days")
q.step("folds_rolling", _fold_sql("f * 250"), "days")
add("walk_forward", "L2", lambda s, d: _folds(s, d), q.build("SELECT * FROM folds", "folds"))
add("walk_forward_rolling", "L2", lambda s, d: _folds(s, d, False), q.build("SELECT * FROM folds_rolling", "folds_rolling"))
add("fold_roles", "L2 L3", lambda s, d: ln.fold_roles(_folds(s, d), _table(s, d)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_dates"), F.min("date").alias("first"), F.max("date").alias("last")),
    q.build("""SELECT fold, role, count(*) AS n_dates, min(date) AS first, max(date) AS last FROM (
      SELECT fold, 'train' AS role, date FROM folds JOIN days ON date BETWEEN train_start AND train_end UNION ALL
      SELECT fold, 'test', date FROM folds JOIN days ON date BETWEEN test_start AND test_end) GROUP BY 1, 2""", "folds", "days"))


def _by_fold(s: SparkSession, d: str) -> DataFrame:
    return rounded(ln.standardize_by_fold(_table(s, d), _folds(s, d), COLS).drop("n", "n1"))


add("standardize_by_fold", "L4", _by_fold,
    q.build("SELECT fold, " + ", ".join(f"round(avg({c}), 6) + 0e0 AS mean_{c}, round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1e0 END, 6) AS sd_{c}" for c in COLS)
            + " FROM train JOIN folds ON date BETWEEN train_start AND train_end GROUP BY 1", "train", "folds"))


def _rule_scored(s: SparkSession, d: str) -> DataFrame:
    """A fixed logistic score instead of a fitted one, so the metrics have a SQL counterpart."""
    p = 1.0 / (1.0 + F.exp(-(F.col("mom5") * 3.0 - F.col("dev20") * 0.2)))
    return _table(s, d).withColumns({"proba": F.round(p, 3), "fold": F.year("date").cast("long")})


_METRICS = q.build("""SELECT fold, count(*) AS n_test, round(avg(CASE WHEN (p >= 5e-1) = (y = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy,
  round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))), 6) AS auc,
  round(-avg(y * ln(greatest(1e-12, least(1e0 - 1e-12, p))) + (1 - y) * ln(1e0 - greatest(1e-12, least(1e0 - 1e-12, p)))), 6) AS logloss FROM (
  SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2e0 AS rk FROM (
    SELECT CAST(year(date) AS BIGINT) AS fold, CAST(y AS DOUBLE) AS y, round(1e0 / (1e0 + exp(-(mom5 * 3e0 - dev20 * 2e-1))), 3) AS p FROM train)) GROUP BY 1""", "train")
add("classification_metrics", "L6 L7 L8 L9", lambda s, d: rounded(ln.classification_metrics(_rule_scored(s, d))), _METRICS)


def _trained(s: SparkSession, d: str) -> DataFrame:
    metrics, _ = ln.train_walk_forward(_table(s, d), _folds(s, d), lambda: ln.ScaledLogistic(COLS))
    return rounded(metrics, 4)


sl.newton("fit5", "train", "folds", COLS, "1e0")
q.step("fit5_scored", f"SELECT f.fold, CAST(r.y AS DOUBLE) AS y, {sl.proba('fit5', COLS)} AS p FROM train r JOIN folds f ON r.date BETWEEN f.test_start AND f.test_end JOIN fit5 b ON b.fold = f.fold JOIN fit5_scale s ON s.fold = f.fold",
       "train", "folds", "fit5", "fit5_scale")
add("train_walk_forward", "L5 L6 L10 U6", _trained, q.build(f"""SELECT m.fold, s.n AS n_train, m.n_test, round(m.accuracy, 4) AS accuracy, round(m.auc, 4) AS auc, round(m.logloss, 4) AS logloss
  FROM ({sl.METRICS.format(scored='SELECT * FROM fit5_scored')}) m JOIN fit5_scale s USING (fold)""", "fit5_scored", "fit5_scale"))


def _coefficients(s: SparkSession, d: str) -> DataFrame:
    """What every fold's fit gives: the coefficients of five features, at full precision but for the last digits."""
    models = ln.ScaledLogistic(COLS, C=0.5, class_weight="balanced").fit_folds(_table(s, d), _folds(s, d, False))
    rows = [(k, m.intercept, *m.coefficients) for k, m in models.items()]
    return rounded(s.createDataFrame(rows, "fold long, " + ", ".join(f"b{i} double" for i in range(len(COLS) + 1))))


sl.newton("fit_rolling", "train", "folds_rolling", COLS, "5e-1", balanced=True)
add("fold_coefficients", "L4 L5", _coefficients, q.build("SELECT fold, " + ", ".join(f"round(b{i}, 6) + 0e0 AS b{i}" for i in range(len(COLS) + 1)) + " FROM fit_rolling", "fit_rolling"))


def _saved(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "model")
    ln.ScaledLogistic(COLS, C=0.5, class_weight="balanced").fit(_table(s, d)).save(path)
    return rounded(ln.ScaledLogistic.load(path).predict(_table(s, d)).select("symbol", "date", "y", "proba", "pred"), 4)


q.step("whole", "SELECT CAST(1 AS BIGINT) AS fold, min(date) AS train_start, max(date) AS train_end FROM train", "train")
sl.newton("fit_whole", "train", "whole", COLS, "5e-1", balanced=True)
add("model_save_load", "L5 L6 L11", _saved, q.build(f"""SELECT symbol, date, y, round(p, 4) AS proba, CASE WHEN p >= 5e-1 THEN 1 ELSE 0 END AS pred
  FROM (SELECT symbol, date, y, {sl.proba('fit_whole', COLS)} AS p FROM train JOIN fit_whole b ON TRUE JOIN fit_whole_scale s ON TRUE)""", "train", "fit_whole", "fit_whole_scale"))

# --- streaming ---------------------------------------------------------------------------------------------


def _finish(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet and read the result."""
    s = stream.sparkSession
    out = new_path(s, "stream")
    w = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", new_path(s, "stream-check"))
    w.trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


def _tick_stream(s: SparkSession, d: str) -> DataFrame:
    schema = demo.table(s, d, "events").schema
    e = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def _closed_ticks(s: SparkSession, d: str) -> DataFrame:
    """The ticks and the closing row that ends their last windows; its own window never closes."""
    ticks, path = _tick_stream(s, d), new_path(s, "closing-tick")
    so.closing_row(demo.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts")), ticks.schema, "ts", "2 hours").write.parquet(path)
    return ticks.unionByName(s.readStream.schema(ticks.schema).parquet(path))


add("stream_resample", "T1 T4", lambda s, d: _finish(so.stream_resample(_closed_ticks(s, d), "1 hour", "10 minutes", tie="event_id")),
    """SELECT * FROM (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) AS start,
      time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) + INTERVAL '1 hour' AS "end", arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS trades FROM events GROUP BY 1, 2)""")


def _twice(s: SparkSession, d: str) -> DataFrame:
    return _tick_stream(s, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")


add("stream_dedupe", "T6 T9", lambda s, d: _finish(so.stream_dedupe(_twice(s, d), ["event_id"], "1 hour")).select("event_id", "symbol", "price"),
    "SELECT event_id, event_type AS symbol, value AS price FROM events")


def _by_span(s: SparkSession, d: str, parts: int = 3) -> DataFrame:
    """The bars with the span of dates (``_part``) they belong to."""
    b = inp.bars(s, d)
    lo, hi = b.agg(F.min("date"), F.max("date")).first()
    span = (hi - lo).days // parts + 1
    end = F.date_add(F.lit(lo), ((F.col("_part") + 1) * span).cast("int"))
    return b.withColumn("_part", F.floor(F.datediff("date", F.lit(lo)) / span)).withColumn("_left", F.datediff(end, "date"))


def _arriving(s: SparkSession, rows: DataFrame, build: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """What a stream emits while the rows of each ``_part`` arrive one after the other; it is stopped and started again in between."""
    spans = settle(rows, "feed", ["_part"])
    plain = spans.drop("_part")
    feed, out, check = (new_path(s, n) for n in ("feed", "stream", "stream-check"))
    for k in range(parts):
        spans.filter(F.col("_part") == k).select(*plain.columns).write.mode("append").parquet(feed)
        stream = build(s.readStream.schema(plain.schema).parquet(feed))
        w = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", check)
        w.trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


def _closed_spans(s: SparkSession, d: str, parts: int = 3) -> DataFrame:
    """The bars by span, and in a span of its own the row that ends the feed."""
    b = _by_span(s, d, parts).drop("_left")
    end = so.closing_row(inp.bars(s, d), b.drop("_part").schema, "date", "3 days").withColumn("_part", F.lit(parts).cast("long"))
    return b.unionByName(end)


add("stream_date_stats", "T1", lambda s, d: rounded(_arriving(s, _closed_spans(s, d), so.stream_date_stats, 4), 9),
    q.build("""SELECT date, count(*) AS n_symbols, round(avg(close), 9) AS mean, round(stddev_pop(close), 9) AS sd FROM bars GROUP BY 1""", "bars"))


def _cross_section(s: SparkSession, d: str) -> DataFrame:
    """Ranks of finished dates; the feed comes in spans, its last row ends it, some bars come twice."""
    spans = _closed_spans(s, d)
    again = spans.filter("symbol is not null and pmod(xxhash64(symbol, date), 9) = 0").withColumns({"close": F.col("close") / 2, "volume": F.col("volume") / 2})
    spans = settle(again.unionByName(spans), "feed", ["_part"])
    feed, out, check = (new_path(s, n) for n in ("feed", "cross-section", "stream-check"))
    plain = spans.drop("_part")
    with rocksdb(s):
        for k in range(4):
            spans.filter(F.col("_part") == k).select(*plain.columns).write.mode("append").parquet(feed)
            tm.stream_cross_section(s.readStream.schema(plain.schema).parquet(feed), out, check, ["close", "volume"], buckets=1).awaitTermination()
    return rounded(s.read.parquet(out).select("symbol", "date", *[f"{c}_{x}" for c in ("close", "volume") for x in ("z", "rank")]))


_Z = "round(CASE WHEN count({c}) OVER w < 2 THEN NULL WHEN stddev_pop({c}) OVER w < 1e-12 THEN 0e0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END, 6) + 0e0 AS {c}_z"
_R = """round(CASE WHEN count(*) OVER w = 1 THEN 5e-1 ELSE (rank() OVER (PARTITION BY date ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2e0) / (count(*) OVER w - 1) END, 6) + 0e0 AS {c}_rank"""
add("stream_cross_section", "T1 T3 T9 D1 D2", _cross_section,
    q.build("SELECT symbol, date, " + ", ".join(x.format(c=c) for c in ("close", "volume") for x in (_Z, _R)) + " FROM bars WINDOW w AS (PARTITION BY date)", "bars"))


def _silence(s: SparkSession, d: str) -> DataFrame:
    """Every event that its symbol followed with more than twenty minutes of silence; the ticks arrive in three spans and a closing row."""
    ticks = demo.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"))
    lo, hi = ticks.agg(F.min("ts"), F.max("ts")).first()
    span = (hi - lo).total_seconds() / 3 + 1
    rows = ticks.withColumn("_part", F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(lo))) / (span * 1e6)).cast("long"))
    end = so.closing_row(ticks, ticks.schema, "ts", "2 hours").withColumn("_part", F.lit(3).cast("long"))
    with rocksdb(s):
        return _arriving(s, rows.unionByName(end), lambda e: tm.stream_silence(e, 1200.0), 4)


add("stream_silence", "T7", _silence,
    """SELECT DISTINCT symbol, ts AS last_ts, true AS stale FROM (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, lead(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY event_type ORDER BY ts) AS nx FROM events)
       WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 1200000000""")


def _untidy(s: SparkSession, d: str, parts: int = 3) -> DataFrame:
    """The bars by span, but of the last month of a span some come with the next one, some twice, some first with another price."""
    chance = F.pmod(F.xxhash64("symbol", "date"), F.lit(10))
    near = (F.col("_left") <= 30) & (F.col("_part") < parts - 1)
    kind = F.when(near & (chance == 0), "late").when(near & (chance == 1), "twice").when(near & (chance == 2), "corrected").otherwise("plain")
    b = _by_span(s, d, parts).withColumn("kind", kind).drop("_left")
    halved = {c: F.when(F.col("kind") == "corrected", F.col(c) / 2).otherwise(F.col(c)) for c in ("close", "volume")}
    again = b.filter("kind <> 'plain'").withColumn("_part", F.col("_part") + 1)
    return b.filter("kind <> 'late'").withColumns(halved).unionByName(again).drop("kind")


def _stream_features(s: SparkSession, d: str) -> DataFrame:
    with rocksdb(s):
        rows = ic.newest(_arriving(s, _untidy(s, d), ic.stream_features, 3))
    return rounded(rows.select("symbol", "date", "n", *ft.FEATURES))


add("stream_features", "T1 T2 T9", _stream_features, q.build(f"SELECT symbol, date, n, {r(*ft.FEATURES)} FROM feats", "feats"))


def _warm_start(s: SparkSession, d: str) -> DataFrame:
    """Features of a history by the batch job, the rest by a stream that starts from its end state."""
    past, cut = inp.bars(s, d), F.lit("1999-06-30").cast("date")
    old = past.filter(F.col("date") <= cut)
    feed = new_path(s, "live-feed")
    past.filter(F.col("date") > cut).write.parquet(feed)
    with rocksdb(s):
        start = settle(ic.end_state(old), "end-state")
        live = ic.newest(_finish(ic.stream_features(s.readStream.schema(past.schema).parquet(feed), start)))
    cols = ["symbol", "date", "n", *ft.FEATURES]
    return rounded(ft.features(old, keep=("close", "volume")).select(*cols).unionByName(live.select(*cols)))


add("stream_features_warm", "T2 T8", _warm_start, q.build(f"SELECT symbol, date, n, {r(*ft.FEATURES)} FROM feats", "feats"))
CFG = StockRegimeConfig()


def _proposals(s: SparkSession, d: str) -> DataFrame:
    p = sr.proposals(sr.signals(inp.feats(s, d)).withColumn("market_stressed", F.lit(False)), CFG)
    return p.select("symbol", "date", "skip", *[f"raw_{i}" for i in range(4)], *[f"conf_{i}" for i in range(4)])


def _stream_regime(s: SparkSession, d: str) -> DataFrame:
    """History by the batch fold, the rest as a stream that continues from its last states."""
    p, m, cut = _proposals(s, d), sr.machine(CFG), F.lit("1999-06-30").cast("date")
    past = hy.run(p.filter(F.col("date") <= cut), m)
    feed = new_path(s, "proposal-feed")
    p.filter(F.col("date") > cut).write.parquet(feed)
    cols = ["symbol", "date", "label", "confidence", "days_in_regime", "regime_start"]
    with rocksdb(s):
        live = _finish(rg.stream_regime(s.readStream.schema(p.schema).parquet(feed), m, rg.last_states(past, m)))
    return rounded(past.select(*cols).unionByName(live.select(*cols)))


q.step("feed_sig", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM srule_raw", "srule_raw")
q.step("feed_state", q.fold("feed_sig", 2, {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}, "6e-1", 7, 3), "feed_sig")
add("stream_regime", "T5 T8", _stream_regime,
    q.build(f"SELECT symbol, date, {q.S_LABEL.format(c='label')} AS label, round(conf, 6) AS confidence, CAST(days AS BIGINT) AS days_in_regime, since AS regime_start FROM feed_state", "feed_state"))
add("feed_age", "T7", lambda s, d: rounded(so.feed_age(demo.ticks(s, d), "2024-01-30 23:50:00", 1800.0)),
    """SELECT symbol, last_ts, round((epoch_us(TIMESTAMP '2024-01-30 23:50:00') - epoch_us(last_ts)) / 1e6, 6) AS age_seconds,
      (epoch_us(TIMESTAMP '2024-01-30 23:50:00') - epoch_us(last_ts)) / 1e6 > 1800 AS stale FROM (
      SELECT event_type AS symbol, max(CAST(ts AS TIMESTAMP)) AS last_ts FROM events GROUP BY 1)""")
