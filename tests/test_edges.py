"""Cases at the edges: file columns by name, rows without a price, sums that do not depend on how rows are cut."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barframe.config import MarketRegimeConfig, PortfolioConstraints, RiskLimits, StockRegimeConfig
from barframe.functions import windows as wf
from barframe.operators import features as ft
from barframe.operators import orders as od
from barframe.operators import portfolio as po
from barframe.plans import segments as sg
from barframe.sources import bars as sb

DAYS = pd.date_range("2023-01-02", periods=4, tz="UTC")


def test_csv_columns_follow_each_files_header(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "AAA_1d.csv").write_text("timestamp,open,high,low,close,volume\n2023-01-02,10,11,9,10.5,100\n")
    (tmp_path / "deep" / "BBB_1d.csv").write_text("close,open,high,low,volume,timestamp\n20.5,20,21,19,200,2023-01-03\n")
    (tmp_path / "V_1d.csv").write_text("t,o,h,l,c,v,vw\n1672704000000,1,3,0.5,2,7,\n")
    got = {(r.symbol, str(r.date)): (r.open, r.high, r.low, r.close, r.volume) for r in sb.read_bars(spark, str(tmp_path)).collect()}
    assert got == {("AAA", "2023-01-02"): (10, 11, 9, 10.5, 100), ("BBB", "2023-01-03"): (20, 21, 19, 20.5, 200), ("V", "2023-01-03"): (1, 3, 0.5, 2, 7)}
    (tmp_path / "CCC_1d.csv").write_text("timestamp,open,high,low\n2023-01-02,1,2,0\n")
    with pytest.raises(ValueError, match="CCC"):
        sb.read_bars(spark, str(tmp_path))


def test_csv_headers_of_any_width_without_a_job(spark, tmp_path):
    extra = [f"x{i}" for i in range(70)]
    (tmp_path / "WIDE_1d.csv").write_text(",".join([*extra, "Date", '"Open"', "HIGH", "low", "close", "volume"]) + "\n" + ",".join(["9"] * 70 + ["2023-01-02", "1", "3", "1", "2", "7"]) + "\n")
    (tmp_path / "A{1}[b]_1d.csv").write_text("\ufeffdate,open,high,low,close,volume,close\n2023-01-03,1,1,1,4,1,8\ndate,open,high,low,close,volume,close\n2023-01-04,1,1,1,,1\n")
    (tmp_path / "BLANK_1d.csv").write_text("\n \ndate,close,open,high,low,volume\n2023-01-05,6,1,1,1,1\n,5,1,1,1,1\n")
    (tmp_path / "NONE_1d.csv").write_text("")
    (tmp_path / "HEAD_1d.csv").write_text("date,open,high,low,close,volume\n")
    spark.sparkContext.setJobGroup("csv-plan", "plan only")
    bars = sb.read_bars(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("csv-read", "read")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("csv-plan")) == []
    got = {(r.symbol, str(r.date)): r.close for r in bars.filter("date is not null").collect()}
    assert got == {("WIDE", "2023-01-02"): 2, ("A{1}[b]", "2023-01-03"): 4, ("A{1}[b]", "2023-01-04"): None, ("BLANK", "2023-01-05"): 6}


def test_csv_files_without_a_line(spark, tmp_path):
    (tmp_path / "NONE_1d.csv").write_text("")
    got = sb.read_bars(spark, str(tmp_path))
    assert got.columns == ["symbol", "date", "open", "high", "low", "close", "volume"] and got.count() == 0


def test_vendor_and_standard_parquet_together(spark, tmp_path):
    pd.DataFrame({"timestamp": DAYS.as_unit("us"), "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 10.0}).to_parquet(tmp_path / "AAA_1d.parquet")
    millis = DAYS.as_unit("ms").asi8
    pd.DataFrame({"t": millis, "o": 5.0, "h": 6.0, "l": 4.0, "c": 5.5, "v": 50.0}).to_parquet(tmp_path / "B+B_1d.parquet")
    got = sb.read_bars(spark, str(tmp_path))
    assert got.filter("close is null or date is null").count() == 0
    assert {(r.symbol, r.close): r["count"] for r in got.groupBy("symbol", "close").count().collect()} == {("AAA", 1.5): 4, ("B+B", 5.5): 4}


def test_whole_number_times_are_told_by_size(spark, tmp_path):
    at = 1_672_704_000
    for name, unit in (("S", 1), ("MS", 10**3), ("US", 10**6), ("NS", 10**9)):
        pd.DataFrame({"timestamp": [at * unit], "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0}).to_parquet(tmp_path / f"{name}_1d.parquet")
    got = sb.read_bars(spark, str(tmp_path))
    assert {(r.symbol, r.date) for r in got.collect()} == {(s, dt.date(2023, 1, 3)) for s in ("S", "MS", "US", "NS")}


def test_last_of_equal_times_wins(spark, tmp_path):
    rows = pd.DataFrame({"timestamp": [DAYS[0]] * 3, "open": 1.0, "high": 1.0, "low": 1.0, "close": [1.0, 2.0, 3.0], "volume": 1.0})
    rows.assign(timestamp=rows["timestamp"].dt.as_unit("us")).to_parquet(tmp_path / "AAA_1d.parquet")
    (tmp_path / "BBB_1d.csv").write_text("timestamp,open,high,low,close,volume\n" + "".join(f"2023-01-02,1,1,1,{k},1\n" for k in (4, 5, 6)))
    assert {r.symbol: r.close for r in sb.read_bars(spark, str(tmp_path)).collect()} == {"AAA": 3.0, "BBB": 6.0}


def test_rows_without_a_price_stay(spark):
    orders = spark.createDataFrame([("o1", "a", "AAA", "BUY", 1.0, "MARKET", None), ("o2", "a", "ZZZ", "SELL", 2.0, "MARKET", None)],
                                   "order_id string, account_id string, symbol string, side string, qty double, order_type string, limit_price double")
    quotes = spark.createDataFrame([("AAA", 9.0, 11.0, 10.0, 12.0, 8.0)], "symbol string, bid double, ask double, last double, high double, low double")
    priced = {r.order_id: r.fill_price for r in od.price_orders(orders, quotes).collect()}
    assert priced["o1"] is not None and priced["o2"] is None and len(priced) == 2
    none = spark.createDataFrame([], "account_id string, cash double")
    accounts = spark.createDataFrame([("a", 1e6)], "account_id string, cash double")
    held = spark.createDataFrame([("a", "ZZZ", 5.0), ("a", "AAA", 3.0)], "account_id string, symbol string, qty double")
    counts = spark.createDataFrame([], "account_id string, open_orders long")
    checked = {r.order_id: (r.accepted, r.reject_reason) for r in od.risk_check(orders, quotes, accounts, held, counts, RiskLimits()).collect()}
    assert checked == {"o1": (True, None), "o2": (False, "No price")}
    costs = spark.createDataFrame([("a", "ZZZ", 4.0), ("a", "AAA", 4.0)], "account_id string, symbol string, avg_price double")
    assert {r.symbol: r.market_value for r in od.valuation(held, costs, quotes).collect()} == {"ZZZ": None, "AAA": 30.0}
    weights = "portfolio_id string, date date, symbol string, weight double"
    day = dt.date(2023, 1, 2)
    new = spark.createDataFrame([("p", day, "AAA", 0.5), ("p", day, "ZZZ", 0.5)], weights)
    prices = spark.createDataFrame([("AAA", 10.0)], "symbol string, price double")
    assert {r.symbol: r.qty for r in po.trades(new, spark.createDataFrame([], weights), prices, 100.0).collect()} == {"AAA": 5.0, "ZZZ": None}
    assert none.count() == 0


def series(spark, n=400):
    first = dt.date(2020, 1, 1)
    rows = [(f"S{i % 3}", first + dt.timedelta(days=i // 3), i, (i * 37 % 101) / 7.0 - 3.1) for i in range(3 * n)]
    return spark.createDataFrame(rows, "symbol string, date date, id long, x double")


def test_running_sums_do_not_depend_on_the_cut(spark):
    df, before = series(spark), spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for rows, parts in ((10**6, "4"), (50, "4"), (7, "3")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = sg.running_sum(df, "symbol", ["date", "id"], F.col("x"), "total", rows=rows)
            got.append(sorted((r.symbol, r.id, r.total) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_ewma_does_not_depend_on_the_cut(spark):
    df = series(spark).withColumn("x", F.when((F.col("symbol") != "S2") | (F.col("id") < 900), F.col("x")))
    got = [sorted((r.symbol, r.date, r.ewma) for r in wf.ewma(df.drop("id"), "x", 0.1, warmup=3, rows=rows).collect()) for rows in (65_536, 96, 32)]
    assert got[0] == got[1] == got[2]
    value, alpha = None, 0.1
    for r in sorted((r for r in df.filter("symbol = 'S0'").collect()), key=lambda r: r.date):
        value = r.x if value is None else alpha * r.x + (1 - alpha) * value
    assert abs(value - [v for s, _, v in got[0] if s == "S0"][-1]) < 1e-9


def test_dollar_volume_needs_every_volume(spark):
    first = dt.date(2023, 1, 2)
    rows = [("A", first + dt.timedelta(days=i), 10.0, None if i == 25 else 100.0) for i in range(60)]
    got = {r.date: r.adv20 for r in ft.features(spark.createDataFrame(rows, "symbol string, date date, close double, volume double"), ["adv20"]).collect()}
    for i in range(60):
        whole = i >= 19 and not (i - 19 <= 25 <= i)
        assert got[first + dt.timedelta(days=i)] == (1000.0 if whole else None)


def test_settings_outside_their_range_raise():
    for make in (lambda: MarketRegimeConfig(z_exit=9.0), lambda: MarketRegimeConfig(vol_lookback=5), lambda: StockRegimeConfig(min_duration=0),
                 lambda: PortfolioConstraints(max_weight=0.0), lambda: PortfolioConstraints(turnover_limit=-1.0), lambda: PortfolioConstraints(selection_mode="x")):
        with pytest.raises(ValueError, match="outside"):
            make()
    assert PortfolioConstraints(turnover_limit=0.2).path_dependent


def test_no_write_while_scores_are_planned(spark):
    from barframe.operators import xsection as xs
    from barframe.plans.settle import shared_dir

    path = shared_dir(spark)
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    xs.xs_zscore(series(spark), ["x"]).explain()
    assert (set(os.listdir(path)) if os.path.isdir(path) else set()) == before
