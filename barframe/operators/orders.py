"""Order costs, execution prices, fills, ledgers and pre-trade checks as joins and aggregates over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.config import CommissionConfig, FillConfig, RiskLimits, SlippageConfig
from barframe.plans import segments as sg

# States and the reasons a rejected order carries.
OPEN = ("ACCEPTED", "PARTIALLY_FILLED")
TOO_MANY, TOO_BIG, NO_CASH = "Too many open orders", " > max_notional_per_trade", "Insufficient cash buffer"
NO_SHORT, OVER_LIMIT, NO_PRICE = "Shorting not allowed", "Position limit exceeded", "No price"

FLAT = 1e-9


def _choose(setting: str, name: str, choices: dict):
    """The entry of ``choices`` for a setting's name."""
    if name not in choices:
        raise ValueError(f"{setting} must be one of {sorted(choices)}, got {name!r}")
    return choices[name]


def commission(qty: Column, cfg: CommissionConfig = CommissionConfig()) -> Column:
    """Fee of one fill."""
    least = F.lit(float(cfg.min_commission))
    fees = {
        "none": F.lit(0.0),
        "fixed_per_order": F.greatest(F.lit(float(cfg.fixed_per_order)), least),
        "per_share": F.greatest(F.abs(qty) * F.lit(float(cfg.per_share)), least),
    }
    return _choose("commission model", cfg.model, fees)


def slippage(ref: Column, cfg: SlippageConfig = SlippageConfig()) -> Column:
    """Dollars per share lost against the reference price."""
    return _choose("slippage model", cfg.model, {"none": F.lit(0.0), "bps": F.abs(ref) * F.lit(cfg.bps / 10_000.0)})


def market_price(fill: FillConfig = FillConfig(), slip: SlippageConfig = SlippageConfig()) -> Column:
    """Execution price of a market order from ``side, bid, ask``."""
    buy = F.col("side") == "BUY"
    mid = (F.col("bid") + F.col("ask")) / 2.0
    ref = F.when(buy, F.col("ask")).otherwise(F.col("bid")) if fill.use_spread_for_market else mid
    cost = slippage(ref, slip) + F.abs(ref) * F.lit(fill.extra_slippage_bps / 10_000.0)
    return F.when(buy, ref + cost).otherwise(ref - cost)


def limit_hit(fill: FillConfig = FillConfig()) -> Column:
    """Whether a limit order trades: the last price, or the bar's range, reaches the limit."""
    last = F.col("last")
    ranges = {"touch": (last, last), "bar_high_low": (F.coalesce("low", last), F.coalesce("high", last))}
    low, high = _choose("limit fill rule", fill.limit_fill_rule, ranges)
    reached = F.when(F.col("side") == "BUY", low <= F.col("limit_price")).otherwise(high >= F.col("limit_price"))
    return F.coalesce(reached, F.lit(False))


def price_orders(
    orders: DataFrame,
    quotes: DataFrame,
    fill: FillConfig = FillConfig(),
    slip: SlippageConfig = SlippageConfig(),
    fees: CommissionConfig = CommissionConfig(),
) -> DataFrame:
    """Price of every order that would trade against the quotes, NULL for the others and for symbols without a quote."""
    d = orders.join(quotes.select("symbol", "bid", "ask", "last", "high", "low"), "symbol", "left")
    price = F.when(F.col("order_type") == "MARKET", market_price(fill, slip)).when(limit_hit(fill), F.col("limit_price"))
    d = d.withColumn("fill_price", price)
    fee = F.when(F.col("fill_price").isNotNull(), commission(F.col("qty"), fees))
    return d.withColumn("fee", fee).select(*orders.columns, "fill_price", "fee")


def split_fills(
    priced: DataFrame, fill: FillConfig = FillConfig(), fees: CommissionConfig = CommissionConfig()
) -> DataFrame:
    """One fill per traded order, or two (the first part, then the rest) when partial fills are on."""
    d = priced.filter(F.col("fill_price").isNotNull() & (F.col("qty") > 0))
    if fill.allow_partial_fills:
        first = F.col("qty") * F.lit(fill.partial_fill_ratio)
        parts = F.array(
            F.struct(F.lit(1).alias("part"), first.alias("q")),
            F.struct(F.lit(2).alias("part"), (F.col("qty") - first).alias("q")),
        )
    else:
        parts = F.array(F.struct(F.lit(1).alias("part"), F.col("qty").alias("q")))
    d = d.withColumn("_p", F.explode(parts)).filter(F.col("_p.q") > 0)
    return d.select(
        F.concat_ws("-", F.col("order_id").cast("string"), F.col("_p.part").cast("string")).alias("fill_id"),
        "order_id", "account_id", "ts", "symbol", "side",
        F.col("_p.q").alias("qty"), F.col("fill_price").alias("price"),
        commission(F.col("_p.q"), fees).alias("fee"),
        F.col("_p.part").alias("part"),
    )


def roll_up(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Filled quantity, average price and status of every order with a fill."""
    done = fills.groupBy("order_id").agg(
        F.sum("qty").alias("filled_qty"),
        (F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("avg_fill_price"),
        F.sum("fee").alias("fees"),
    )
    d = done.join(orders.select("order_id", F.col("qty").alias("order_qty")), "order_id")
    full = F.abs(F.col("filled_qty") - F.col("order_qty")) < FLAT
    return d.withColumn("status", F.when(full, "FILLED").otherwise("PARTIALLY_FILLED"))


def signed_qty() -> Column:
    return F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))


def cash_change() -> Column:
    notional = F.col("qty") * F.col("price")
    return F.when(F.col("side") == "BUY", -(notional + F.col("fee"))).otherwise(notional - F.col("fee"))


def ledger(fills: DataFrame, start_cash: float = 100_000.0, by: str = "account_id") -> DataFrame:
    """Cash balance of each account after every fill.

    Accounts may be very unequal, so balances are prefix sums over days instead of one window per account.
    """
    d = fills.withColumn("cash_change", cash_change())
    d = sg.running_sum(d, by, ["ts", "fill_id"], F.col("cash_change"), "cash")
    return d.withColumn("cash", F.col("cash") + F.lit(float(start_cash)))


def positions(fills: DataFrame, by: tuple[str, ...] = ("account_id", "symbol")) -> DataFrame:
    """Net signed quantity per account and symbol; flat positions are dropped."""
    d = fills.groupBy(*by).agg(F.sum(signed_qty()).alias("qty"))
    return d.filter(F.abs("qty") >= FLAT)


def position_path(fills: DataFrame, by: tuple[str, ...] = ("account_id", "symbol")) -> DataFrame:
    """Net quantity after every fill."""
    return sg.running_sum(fills, list(by), ["ts", "fill_id"], signed_qty(), "position")


def open_orders(orders: DataFrame, by: str = "account_id") -> DataFrame:
    return orders.groupBy(by).agg(F.count_if(F.col("status").isin(*OPEN)).alias("open_orders"))


def risk_check(
    new: DataFrame,
    quotes: DataFrame,
    accounts: DataFrame,
    held: DataFrame,
    open_counts: DataFrame,
    limits: RiskLimits = RiskLimits(),
) -> DataFrame:
    """Accept or reject each order; ``reject_reason`` is the first rule it breaks. An order without a price is rejected."""
    d = (
        new.join(quotes.select("symbol", "last"), "symbol", "left")
        .join(accounts.select("account_id", "cash"), "account_id", "left")
        .join(held.select("account_id", "symbol", F.col("qty").alias("_held")), ["account_id", "symbol"], "left")
        .join(open_counts.select("account_id", "open_orders"), "account_id", "left")
    )
    zero, buy = F.lit(0.0), F.col("side") == "BUY"
    notional = F.abs(F.col("qty") * F.col("last"))
    after = F.coalesce("_held", zero) + F.when(buy, F.col("qty")).otherwise(-F.col("qty"))
    too_big = F.concat(F.lit("Trade notional "), F.format_string("%.2f", F.col("notional")), F.lit(TOO_BIG))
    d = d.withColumns({"notional": notional, "new_qty": after, "cash": F.coalesce("cash", zero)})
    reason = (
        F.when(F.coalesce("open_orders", F.lit(0)) >= limits.max_open_orders, TOO_MANY)
        .when(F.col("last").isNull(), NO_PRICE)
        .when(F.col("notional") > limits.max_notional_per_trade, too_big)
        .when(buy & (F.col("cash") - F.col("notional") < limits.min_cash_buffer), NO_CASH)
    )
    if not limits.allow_short:
        reason = reason.when(F.col("new_qty") < 0, NO_SHORT)
    reason = reason.when(F.abs(F.col("new_qty") * F.col("last")) > limits.max_position_notional, OVER_LIMIT)
    return d.withColumn("reject_reason", reason).select(
        *new.columns, "notional", "new_qty", F.col("reject_reason").isNull().alias("accepted"), "reject_reason"
    )


def average_cost(fills: DataFrame, by: tuple[str, ...] = ("account_id", "symbol")) -> DataFrame:
    """Quantity-weighted price of the buys."""
    buys = fills.filter(F.col("side") == "BUY")
    return buys.groupBy(*by).agg((F.sum(F.col("qty") * F.col("price")) / F.sum("qty")).alias("avg_price"))


def valuation(held: DataFrame, costs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Market value and unrealised profit of every position; NULL where the symbol has no quote."""
    d = held.join(costs, ["account_id", "symbol"], "left").join(
        quotes.select("symbol", F.col("last").alias("market_price")), "symbol", "left"
    )
    gain = F.col("qty") * (F.col("market_price") - F.col("avg_price"))
    basis = F.abs(F.col("qty") * F.col("avg_price"))
    return d.select(
        "account_id", "symbol", "qty", "avg_price", "market_price",
        (F.col("qty") * F.col("market_price")).alias("market_value"),
        gain.alias("unrealized_pnl"),
        F.when(basis > 0, gain / basis * 100.0).alias("unrealized_pnl_pct"),
        F.when(F.col("qty") < 0, "short").otherwise("long").alias("side"),
    )


def dedupe_fills(events: DataFrame, ids: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """First report of each broker fill of ours with a quantity.

    ``ids`` maps ``broker_id`` to ``order_id``; ``seen`` holds broker ids handled before.
    """
    d = events.filter(F.col("status").isin("filled", "partially_filled") & (F.col("qty") > 0))
    d = d.join(ids.select("broker_id", "order_id"), "broker_id")
    if seen is not None:
        d = d.join(seen.select("broker_id"), "broker_id", "left_anti")
    rest = [c for c in d.columns if c != "broker_id"]
    first = F.min_by(F.struct(*rest), F.struct("ts", "event_id"))
    return d.groupBy("broker_id").agg(first.alias("_f")).select("broker_id", "_f.*")


def merge_orders(ours: DataFrame, theirs: DataFrame, key: str = "order_id") -> DataFrame:
    """Our orders plus the other source's orders with an id we do not have."""
    return ours.unionByName(theirs.join(ours.select(key), key, "left_anti"), allowMissingColumns=True)


def latest_state(events: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Last event of each key; combined before the shuffle, so a chatty key costs nothing extra."""
    keys = sg.as_list(key)
    rest = [c for c in events.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*")


def fill_ids_by_order(fills: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` fills of each order, newest first."""
    w = Window.partitionBy("order_id").orderBy(F.desc("ts"), F.desc("fill_id"))
    return fills.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
