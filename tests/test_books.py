import datetime as dt
import math
import os
import random
import shutil

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import Window
from pyspark.sql import functions as F

from barframe.config import AlphaConfig, EvaluationConfig, PortfolioConstraints, RouterConfig
from barframe.operators import alpha as al
from barframe.operators import performance as pf
from barframe.operators import portfolio as po
from barframe.operators import xsection as xs
from barframe.plans.evaluate import evaluate
from tests import plain
from workload import sql as q
from workload.books import LIMITED

D = dt.date(2024, 1, 2)
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def book(spark, weights, name="p", date=D):
    rows = [(name, date, s, float(x), float(x)) for s, x in weights.items()]
    return spark.createDataFrame(rows, "portfolio_id string, date date, symbol string, score double, weight double")


def as_dict(df):
    return {r["symbol"]: r["weight"] for r in df.collect()}


@SLOW
@given(hs.lists(hs.lists(hs.floats(0, 1), min_size=1, max_size=12), min_size=1, max_size=6), hs.sampled_from([0.05, 0.2, 0.35, 1.0]))
def test_cap_equals_repeated_clipping(spark, books, limit):
    rows = []
    for b, ws in enumerate(books):
        total = sum(ws) or 1.0
        rows += [(str(b), D, f"S{i:02d}", w / total, w / total) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "portfolio_id string, date date, symbol string, score double, weight double")
    got = {(r["portfolio_id"], r["symbol"]): r["weight"] for r in po.cap_weights(df, limit).collect()}
    for b in range(len(books)):
        mine = {s: w for p, _, s, _, w in rows if p == str(b)}
        want = plain.cap(mine, limit)
        for s in mine:
            assert got[(str(b), s)] == pytest.approx(want[s], abs=1e-12)


@SLOW
@given(hs.lists(hs.one_of(hs.none(), hs.integers(-3, 3).map(float)), min_size=2, max_size=30), hs.sampled_from([0, 10_000]))
def test_rank_equals_plain_rank(spark, values, rows):
    df = spark.createDataFrame([(D, f"S{i}", v) for i, v in enumerate(values)], "date date, symbol string, x double")
    got = {r["symbol"]: r["rank"] for r in xs.xs_rank(df, "x", rows=rows).collect()}
    known = [(f"S{i}", v) for i, v in enumerate(values) if v is not None]
    want = dict(zip([s for s, _ in known], plain.ranks([v for _, v in known]))) if len(known) > 1 else {s: 0.5 for s, _ in known}
    for i in range(len(values)):
        assert plain.close(got[f"S{i}"], want.get(f"S{i}"), 1e-12)


def test_rank_in_parts_on_one_large_group(spark):
    rng = random.Random(3)
    values = [0.0] * 900 + [rng.gauss(0, 1) for _ in range(1800)]  # a third of the rows share one value
    df = spark.createDataFrame([(D, f"S{i}", v) for i, v in enumerate(values)], "date date, symbol string, x double")
    got = {r["symbol"]: r["rank"] for r in xs.xs_rank(df, "x", rows=100).collect()}
    order = {v: k for k, v in enumerate(sorted(values))}
    for i, v in enumerate(values):
        if v != 0.0:
            assert got[f"S{i}"] == pytest.approx(order[v] / (len(values) - 1))
    assert len({got[f"S{i}"] for i in range(900)}) == 1


def test_zscore_forms(spark):
    df = spark.createDataFrame([(D, "A", 1.0), (D, "B", 3.0), (D, "C", 5.0), (D, "N", None), (dt.date(2024, 1, 3), "A", 2.0)],
                               "date date, symbol string, x double")
    z = {(r["date"], r["symbol"]): r["x_z"] for r in xs.xs_zscore(df, ["x"]).collect()}
    assert z[(D, "A")] == pytest.approx(-1.224744871) and z[(D, "N")] is None and z[(dt.date(2024, 1, 3), "A")] is None
    zero = {(r["date"], r["symbol"]): r["x_z"] for r in xs.xs_zscore(df, ["x"], on_too_few="zero").collect()}
    assert zero[(dt.date(2024, 1, 3), "A")] == 0.0 and zero[(D, "N")] is None


def test_full_constructor_invariants(spark):
    rng = random.Random(11)
    scores = {f"S{i:02d}": rng.random() for i in range(40)}
    cons = PortfolioConstraints(max_positions=15, min_positions=5, max_weight=0.09, min_weight=0.05)
    got = as_dict(po.target_weights(book(spark, scores).drop("weight"), cons))
    assert len(got) <= 15 and sum(got.values()) == pytest.approx(1.0)
    assert all(0.05 - 1e-12 <= x <= 0.09 + 1e-12 for x in got.values())
    assert min(scores[s] for s in got) >= sorted(scores.values())[-15]


def test_short_book_keeps_cash_and_ties_break_by_symbol(spark):
    cons = PortfolioConstraints(max_positions=2, min_positions=2, max_weight=1.0)
    got = as_dict(po.target_weights(book(spark, {"B": 1, "A": 1, "C": 1}).drop("weight"), cons))
    assert got == {"A": 0.5, "B": 0.5}
    short = PortfolioConstraints(max_positions=20, min_positions=10, max_weight=1.0)
    assert sum(as_dict(po.target_weights(book(spark, {"A": 1, "B": 1}).drop("weight"), short)).values()) == pytest.approx(0.2)


def test_infeasible_cap_leaves_cash(spark):
    cons = PortfolioConstraints(max_positions=3, min_positions=1, max_weight=0.2)
    got = as_dict(po.target_weights(book(spark, {"A": 3, "B": 2, "C": 1}).drop("weight"), cons))
    assert got == {"A": 0.2, "B": 0.2, "C": 0.2}


def test_risk_multiplier_is_clamped_and_drops_at_floor(spark):
    risk = spark.createDataFrame([("A", 0.0), ("B", 5.0)], "symbol string, multiplier double")
    got = {r["symbol"]: r["score"] for r in po.apply_risk(book(spark, {"A": 1, "B": 1, "C": 1}), risk, PortfolioConstraints()).collect()}
    assert got == {"B": 1.0, "C": 1.0}


def naive_step(target, held, cons):
    w = dict(target)
    if cons.rebalance_band > 0 and held:
        for s in w:
            old = held.get(s, 0.0)
            if old and w[s] and abs(w[s] - old) < cons.rebalance_band:
                w[s] = old
        total = sum(w.values())
        if total > 0:
            k = min(cons.gross_target, total) / total
            w = plain.cap({s: x * k for s, x in w.items()}, cons.max_weight)
    if cons.turnover_limit is not None and held:
        names = set(w) | set(held)
        t = sum(abs(w.get(s, 0.0) - held.get(s, 0.0)) for s in names)
        if t > cons.turnover_limit:
            k = cons.turnover_limit / t
            moved = {s: max(0.0, held.get(s, 0.0) + k * (w.get(s, 0.0) - held.get(s, 0.0))) for s in names}
            w = plain.cap({s: x for s, x in moved.items() if x > 0}, cons.max_weight)
    return w


def test_path_equals_plain_loop(spark):
    rng = random.Random(5)
    books = {"banded": PortfolioConstraints(max_weight=0.4, min_positions=1, rebalance_band=0.05),
             "limited": PortfolioConstraints(max_weight=0.4, min_positions=1, turnover_limit=0.25)}
    days = plain.days(12)
    for name, cons in books.items():
        rows, want, held = [], {}, {}
        for d in days:
            raw = {f"S{i}": rng.random() for i in range(6) if rng.random() < 0.7} if d != days[6] else {}
            total = sum(raw.values())
            target = plain.cap({s: x / total for s, x in raw.items()}, cons.max_weight) if raw else {}
            rows += [(name, d, s, x) for s, x in target.items()]
            held = naive_step(target, held, cons)
            want[d] = dict(held)
        targets = spark.createDataFrame(rows, "portfolio_id string, date date, symbol string, weight double")
        dates = spark.createDataFrame([(name, d) for d in days], "portfolio_id string, date date")
        got = {}
        for r in po.rebalance_path(targets, dates, cons, batch=5).collect():
            got.setdefault(r["date"], {})[r["symbol"]] = r["weight"]
        for d in days:
            assert got.get(d, {}).keys() == want[d].keys()
            for s, x in want[d].items():
                assert got[d][s] == pytest.approx(x, abs=1e-12)


def test_limited_moves_taken_back_equal_sql(spark):
    """A move cut to the limit and taken back the day after trades the limit exactly; rounding must decide as in the SQL, row for row."""
    rng = random.Random(3)
    days, books = plain.days(60), []
    for k in range(len(days)):
        weights = [(23 - i) / 185 for i in range(10)]
        books.append(books[k - 2] if k % 3 == 2 else dict(zip((f"Brand#{j}" for j in rng.sample(range(25), 10)), weights, strict=True)))
    rows = [("limited", d, s, x) for d, b in zip(days, books, strict=True) for s, x in b.items()]
    con = duckdb.connect()
    con.execute("CREATE TABLE w_cap (portfolio_id VARCHAR, date DATE, symbol VARCHAR, weight DOUBLE)")
    con.executemany("INSERT INTO w_cap VALUES (?, ?, ?, ?)", rows)
    con.execute("CREATE VIEW book AS SELECT * FROM w_cap")
    steps = ",\n".join(f"{n} AS ({q.STEPS[n][1].replace('{me}', n)})" for n in ("limited_days", "limited_scan", "limited"))
    want = con.execute(f"WITH RECURSIVE {steps} SELECT date, symbol, weight FROM limited").fetchall()
    targets = spark.createDataFrame(rows, "portfolio_id string, date date, symbol string, weight double")
    got = po.rebalance_path(targets, targets.select("portfolio_id", "date"), LIMITED)
    assert sorted((r["date"], r["symbol"], r["weight"]) for r in got.collect()) == sorted(want)


def test_weight_path_goes_on_after_any_batch(spark, tmp_path):
    """Batches of dates give the path of one scan; a folder that lacks its last batches is finished, the others are not written again."""
    rng = random.Random(11)
    cons = PortfolioConstraints(max_positions=6, min_positions=2, max_weight=0.4, rebalance_band=0.05, turnover_limit=0.3)
    days = plain.days(30)
    rows = [(p, d, f"S{i}", rng.random() / 4) for p in "AB" for k, d in enumerate(days) if k != 13 for i in rng.sample(range(9), 5)]
    targets = spark.createDataFrame(rows, "portfolio_id string, date date, symbol string, weight double")
    dates = spark.createDataFrame([("A", d) for d in days] + [("B", d) for d in days[4:21]], "portfolio_id string, date date")
    read = lambda df: {(r["portfolio_id"], r["date"], r["symbol"]): r["weight"] for r in df.collect()}
    whole = read(po.rebalance_path(targets, dates, cons))
    folder = str(tmp_path / "path")
    assert read(po.rebalance_path(targets, dates, cons, batch=7, folder=folder)) == whole
    stopped = str(tmp_path / "stopped")
    for k in range(3):
        shutil.copytree(f"{folder}/batch={k}", f"{stopped}/batch={k}")
    before = os.path.getmtime(f"{stopped}/batch=2/_SUCCESS")
    assert read(po.rebalance_path(targets, dates, cons, batch=7, folder=stopped)) == whole
    assert os.path.getmtime(f"{stopped}/batch=2/_SUCCESS") == before


def states(spark, market="calm_trend", stocks=None):
    m = spark.createDataFrame([(D, market, 0.8)], "date date, label string, confidence double")
    s = spark.createDataFrame([(k, D, v, 0.9) for k, v in stocks.items()], "symbol string, date date, label string, confidence double")
    return m, s


def scores_of(spark, values):
    rows = [(D, s, m, x, x, 0.9) for m, per in values.items() for s, x in per.items()]
    return spark.createDataFrame(rows, "date date, symbol string, model string, score double, raw double, confidence double")


def test_router_gates_and_weights(spark):
    names = {"U": "trending_up", "R": "range_low_vol", "X": "stressed_high_vol", "D": "trending_down", "N": "no_trade"}
    m, s = states(spark, "calm_trend", names)
    values = {k: {n: 2.0 for n in names} for k in ("momentum", "meanrev", "lowvol")}
    got = {r["symbol"]: r for r in al.route(scores_of(spark, values), m, s).collect()}
    unit = 2.0 * 0.9 * 0.9
    assert got["U"]["score"] == pytest.approx(2 * unit) and got["R"]["score"] == pytest.approx(2.3 * unit)
    assert got["X"]["score"] == pytest.approx(0.8 * unit) and got["D"]["score"] == 0 and got["N"]["gate"] == "stock_no_trade"
    assert got["U"]["contributions"]["meanrev"] == 0.0
    strict = {r["symbol"]: r["score"] for r in al.route(scores_of(spark, values), m, s, RouterConfig(exclude_stressed=True)).collect()}
    assert strict["X"] == 0.0
    m2, _ = states(spark, "stress", names)
    damped = {r["symbol"]: r["score"] for r in al.route(scores_of(spark, values), m2, s).collect()}
    assert damped["U"] == pytest.approx((0.5 + 1.0) * unit)
    m3, _ = states(spark, "crisis", names)
    assert all(r["score"] == 0 for r in al.route(scores_of(spark, values), m3, s).collect())


def test_unlisted_model_routes_at_full_weight_and_negative_scores_do_not_count(spark):
    m, s = states(spark, "calm_range", {"U": "trending_up"})
    got = al.route(scores_of(spark, {"mine": {"U": 1.0}, "momentum": {"U": -1.0}}), m, s).first()
    assert got["score"] == pytest.approx(0.81) and got["raw"] == pytest.approx(0.0, abs=1e-12)


def test_gated_symbols_share_a_rank_unless_put_back(spark):
    d = spark.createDataFrame([(D, f"S{i}", 0.1 * i, 0.0, 0.0, 0.3, 0.3) for i in range(4)],
                              "date date, symbol string, mom63 double, dev20 double, rv20_z double, rv60 double, rv20 double")
    m, s = states(spark, "calm_trend", {"S0": "trending_down", "S1": "trending_down", "S2": "trending_up", "S3": "trending_up"})
    got = {r["symbol"]: r["score"] for r in al.ensemble(d, m, s).collect()}
    assert got["S0"] == got["S1"] == pytest.approx(0.5 / 3) and got["S3"] == 1.0
    back = {r["symbol"]: r["score"] for r in al.ensemble(d, m, s, AlphaConfig(gate_after_rank=True)).collect()}
    assert back["S0"] == back["S1"] == 0.0 and back["S3"] == 1.0


def test_clip_long_only_keeps_positive_gross(spark):
    got = as_dict(po.clip_long_only(book(spark, {"A": 0.6, "B": -0.1, "C": 0.0})))
    assert got == {"A": 0.6}
    assert as_dict(po.clip_long_only(book(spark, {"A": 0.6, "C": 0.0}))) == {"A": 0.6, "C": 0.0}


def test_auto_constraints():
    assert PortfolioConstraints.for_universe(5).max_weight == 0.25
    assert PortfolioConstraints.for_universe(25).max_weight == 0.08
    assert PortfolioConstraints.for_universe(400).max_weight == 0.05
    for bad in (dict(max_weight=0.0), dict(min_positions=60), dict(top_quantile=0.0), dict(min_weight=0.2)):
        with pytest.raises(ValueError):
            PortfolioConstraints(**bad)


@pytest.fixture(scope="module")
def run(spark):
    rows = []
    for k, name in enumerate(["SPY", "AAPL", "MSFT", "GOOG", "AMZN"]):
        closes = plain.walk(300, 42 + k, start=100.0 + 20 * k)
        for i, (d, c) in enumerate(zip(plain.days(300, dt.date(2022, 1, 3)), closes)):
            if not (name == "GOOG" and i % 37 == 5):
                rows.append((name, d, c, 1e6))
    df = spark.createDataFrame(rows, "symbol string, date date, close double, volume double")
    return rows, df, evaluate(df, "SPY", EvaluationConfig())


def test_nav_equals_plain_loop(run):
    rows, _, ev = run
    price = {}
    for s, d, c, _ in rows:
        price.setdefault(d, {})[s] = c
    weights = {}
    for r in ev.weights.collect():
        weights.setdefault(r["date"], {})[r["symbol"]] = r["weight"]
    dates = sorted(price)
    live = {r["date"] for r in ev.rebalances.collect()}
    value, held, last, want = 100_000.0, {}, {}, {}
    for d in dates:
        before = dict(last)
        last.update(price[d])
        if held and before:
            value *= 1 + sum(w * (last[s] / before[s] - 1) for s, w in held.items() if w > 0 and s in before)
        if d in live:
            held = weights.get(d, {})
        want[d] = value
    got = {r["date"]: r["nav"] for r in ev.nav.collect()}
    assert got.keys() == want.keys()
    for d in dates:
        assert got[d] == pytest.approx(want[d], rel=1e-10)
    stats = ev.stats.first()
    assert stats["n_trading_days"] == len(dates) - 1 and stats["n_rebalances"] == len(live)
    peak, worst = -math.inf, 0.0
    for d in dates:
        peak = max(peak, want[d])
        worst = min(worst, want[d] / peak - 1)
    assert stats["max_drawdown"] == pytest.approx(worst)


def test_weights_obey_constraints_and_labels_are_known(run):
    _, _, ev = run
    sums = ev.weights.groupBy("date").agg(F.sum("weight").alias("g"), F.max("weight").alias("m"), F.min("weight").alias("l")).collect()
    assert sums and all(x["g"] <= 1 + 1e-9 and x["m"] <= 0.25 + 1e-12 and x["l"] >= 0 for x in sums)
    assert "SPY" not in {r["symbol"] for r in ev.weights.select("symbol").distinct().collect()}
    labels = {r["label"] for r in ev.market_regime.select("label").distinct().collect()}
    assert labels <= {"calm_trend", "calm_range", "stress", "crisis"}


def test_weights_do_not_look_ahead(spark, run):
    rows, _, ev = run
    cut = plain.days(300, dt.date(2022, 1, 3))[260]
    changed = [(s, d, c * (1.5 if d > cut else 1.0), v) for s, d, c, v in rows]
    df = spark.createDataFrame(changed, "symbol string, date date, close double, volume double")
    other = evaluate(df, "SPY", EvaluationConfig())
    key = lambda r: (r["date"], r["symbol"])
    a = sorted((r for r in ev.weights.collect() if r["date"] <= cut), key=key)
    b = sorted((r for r in other.weights.collect() if r["date"] <= cut), key=key)
    assert a and [(key(r), r["weight"]) for r in a] == [(key(r), r["weight"]) for r in b]


def test_missing_benchmark_uses_default_regime(spark, run):
    rows, _, _ = run
    df = spark.createDataFrame([r for r in rows if r[0] != "SPY"], "symbol string, date date, close double, volume double")
    ev = evaluate(df, "SPY", EvaluationConfig())
    assert {(r["label"], r["confidence"]) for r in ev.market_regime.collect()} == {("calm_range", 0.0)}


def test_short_series_stats(spark):
    nav = spark.createDataFrame([("p", D, 100.0)], "portfolio_id string, date date, nav double")
    empty = spark.createDataFrame([], "portfolio_id string, date date, symbol string, weight double")
    days = spark.createDataFrame([("p", D)], "portfolio_id string, date date")
    got = pf.perf_stats(nav, empty, days).first()
    assert got["total_return"] == 0.0 and got["n_trading_days"] == 1 and got["sharpe_ratio"] is None


def test_parts_can_be_replaced(run):
    from barframe.plans.evaluate import Parts

    _, df, _ = run

    def detector(panel, market):
        label = F.when(F.col("symbol") == "AAPL", "trending_down").otherwise("trending_up")
        return panel.select("symbol", "date", label.alias("label"), F.lit(1.0).alias("confidence"))

    def five_day(panel):
        z = F.coalesce(F.col("dev20"), F.lit(0.0))
        return panel.select("date", "symbol", z.alias("score"), z.alias("raw"), F.lit(1.0).alias("confidence"))

    def equal(scores, cons):
        n = F.count(F.lit(1)).over(Window.partitionBy("portfolio_id", "date"))
        return scores.filter("score > 0").withColumn("weight", 1.0 / n)

    weights = {k: {**v, "mine": 0.5} for k, v in AlphaConfig().ensemble_weights.items()}
    cfg = EvaluationConfig(alpha=AlphaConfig(ensemble_weights=weights, gate_after_rank=True))
    ev = evaluate(df, "SPY", cfg, parts=Parts(detector, {"mine": five_day}, equal))
    rows = ev.weights.collect()
    assert rows and "AAPL" not in {r["symbol"] for r in rows}
    assert {r["s"] for r in ev.weights.groupBy("date").agg(F.round(F.sum("weight"), 9).alias("s")).collect()} == {1.0}
