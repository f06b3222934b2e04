import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barframe.config import MarketRegimeConfig, StockRegimeConfig
from barframe.operators import hysteresis as hy
from barframe.operators import market_regime as mr
from barframe.operators import panel as pn
from barframe.operators import stock_regime as sr
from tests import plain

MACHINES = {
    "market": mr.machine(MarketRegimeConfig()),
    "stock": sr.machine(StockRegimeConfig()),
    "short": hy.Machine(("x", "y", "z"), (0, 1, 1), 1, 2, 1, 0.5, (2,)),
}


@pytest.mark.parametrize("name", list(MACHINES))
@pytest.mark.parametrize("rows", [10_000, 37])
def test_fold_equals_plain_rule(spark, name, rows):
    m = MACHINES[name]
    rng = random.Random(len(name))
    data, want = [], {}
    for key, size in (("A", 400), ("B", 123), ("C", 37), ("D", 1)):
        own, sticky = [], [0] * m.n_classes
        for d in plain.days(size):
            if rng.random() < 0.2:
                sticky = [rng.randrange(len(m.labels)) for _ in range(m.n_classes)]
            conf = [rng.random() for _ in range(m.n_classes)]
            own.append((d, list(sticky), conf, rng.random() < 0.1))
        want[key] = plain.hysteresis(own, m.gate, m.min_duration, m.klass, m.start_class, m.instant)
        data += [(key, d, *raw, *conf, skip) for d, raw, conf, skip in own]
    k = range(m.n_classes)
    schema = "symbol string, date date, " + ", ".join(f"raw_{i} int" for i in k) + ", " + ", ".join(f"conf_{i} double" for i in k) + ", skip boolean"
    rng.shuffle(data)
    got = hy.run(spark.createDataFrame(data, schema), m, rows=rows).orderBy("symbol", "date").collect()
    for key in want:
        mine = [r for r in got if r["symbol"] == key]
        for r, (label, conf, n, since) in zip(mine, want[key]):
            assert r["label"] == (None if label is None else m.labels[label])
            assert plain.close(r["confidence"], conf, 1e-12)
            assert (r["days_in_regime"], r["regime_start"]) == (n, since)


def bars(spark, closes, name="SPY", start=dt.date(2019, 1, 1)):
    rows = [(name, d, c) for d, c in zip(plain.days(len(closes), start), closes)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def test_market_batch_and_live_agree_at_the_end(spark):
    closes = plain.walk(500, 42, 0.0008, 0.008) + plain.walk(120, 7, -0.01, 0.03, 90.0)
    feats = mr.market_features(bars(spark, closes))
    batch = mr.market_regime(feats, mode="batch").orderBy("date").collect()
    assert all(r["label"] is None for r in batch[:271]) and batch[271]["label"] is not None
    assert batch[-1]["label"] == "stress"
    assert all(0 <= r["confidence"] <= 1 for r in batch[271:])


def test_live_reports_default_until_thirty_bars(spark):
    live = mr.market_regime(mr.market_features(bars(spark, plain.walk(60, 3)))).orderBy("date").collect()
    assert {(r["label"], r["confidence"]) for r in live[:29]} == {("calm_range", 0.0)}
    assert live[29]["scores"]["days_in_regime"] == 1


def test_live_counts_dates_without_a_benchmark_bar(spark):
    closes = plain.walk(60, 3)
    b = bars(spark, closes)
    gaps = b.filter(F.dayofmonth("date") % 5 != 0)
    feats = mr.market_features(gaps)
    seen = mr.asof_features(feats, pn.calendar(b), start="2019-02-15")
    out = mr.market_regime(seen).orderBy("date").collect()
    assert len(out) == b.filter("date >= '2019-02-15'").count()
    first, last = out[0], out[-1]
    if last["scores"]["regime_start_date"] == first["date"]:
        assert last["scores"]["days_in_regime"] == len(out)


def test_min_duration_blocks_and_halves(spark):
    m = mr.machine(MarketRegimeConfig())
    d = plain.days(9)
    rows = [("A", x, *([2] * 4 if i == 0 else [3] * 4), *[0.9] * 4, False) for i, x in enumerate(d)]
    schema = "symbol string, date date, raw_0 int, raw_1 int, raw_2 int, raw_3 int, conf_0 double, conf_1 double, conf_2 double, conf_3 double, skip boolean"
    got = hy.run(spark.createDataFrame(rows, schema), m).orderBy("date").collect()
    assert [r["label"] for r in got] == ["choppy_normal"] * 7 + ["stressed"] * 2
    assert got[1]["confidence"] == pytest.approx(0.45) and got[7]["confidence"] == pytest.approx(0.9)


def panel_rows(spark, rows):
    schema = "symbol string, date date, normalized_slope double, rv20 double, rv20_z double, max_dd_90 double, mom63 double, trend_gap double"
    return spark.createDataFrame(rows, schema)


def test_stock_first_label_stress_and_no_trade(spark):
    d = plain.days(4)
    rows = [
        ("UP", d[0], 0.9, 0.2, 0.0, -0.05, 0.2, 0.1),
        ("UP", d[1], 0.9, 0.2, 1.3, -0.05, 0.2, 0.1),
        ("NA", d[0], None, 0.2, 0.0, 0.0, 0.1, 0.1),
        ("QUIET", d[0], 0.0, 0.0, 0.0, 0.0, 0.0, None),
    ]
    market = spark.createDataFrame([(d[0], "calm_trend"), (d[1], "stress")], "date date, label string")
    got = {(r["symbol"], r["date"]): r for r in sr.stock_regime(panel_rows(spark, rows), market).collect()}
    assert got[("UP", d[0])]["label"] == "trending_up"
    assert got[("UP", d[0])]["confidence"] == pytest.approx(min(1, 0.5 + 0.7 / 3 + 0.1 + 0.04))
    # a stressed market lowers the entry threshold to 1.2, and stress enters at once
    assert got[("UP", d[1])]["label"] == "stressed_high_vol"
    assert got[("NA", d[0])]["label"] == "no_trade" and got[("NA", d[0])]["reasons"] is None
    assert got[("QUIET", d[0])]["confidence"] == pytest.approx(1.0)


def test_config_validation():
    with pytest.raises(ValueError):
        MarketRegimeConfig(z_exit=2.0)
    with pytest.raises(ValueError):
        StockRegimeConfig(min_duration=0)
    with pytest.raises(ValueError):
        MarketRegimeConfig(vol_lookback=100)


def _maybe(rng, lo, hi, share=0.15):
    return None if rng.random() < share else rng.uniform(lo, hi)


@pytest.mark.parametrize("cfg", [MarketRegimeConfig(), MarketRegimeConfig.sensitive(), MarketRegimeConfig(use_ma_crossover=False)])
def test_market_proposals_equal_plain_rule(spark, cfg):
    rng = random.Random(12)
    rows = [(i, _maybe(rng, -2, 3), _maybe(rng, -0.2, 0), _maybe(rng, -1, 1), rng.choice([-1, 0, 1])) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, z_vol double, max_dd double, normalized_slope double, ma_flag int")
    for r in mr.proposals(df, cfg).collect():
        for prev in range(4):
            flag = r["ma_flag"] if cfg.use_ma_crossover else 0
            label, conf = plain.market_raw(r["z_vol"], r["max_dd"], r["normalized_slope"], flag, prev, cfg)
            assert r[f"raw_{prev}"] == label and plain.close(r[f"conf_{prev}"], conf, 1e-12), (r, prev)


def test_stock_proposals_equal_plain_rule(spark):
    cfg, rng = StockRegimeConfig(), random.Random(13)
    names = ["normalized_slope", "rv20", "rv20_z", "max_dd_90", "mom63", "trend_gap"]
    rows = [(f"S{i}", *[_maybe(rng, *b) for b in ((-1, 1), (0, 0.5), (-2, 3), (-0.4, 0), (-0.5, 0.5), (-0.2, 0.2))], rng.random() < 0.5) for i in range(800)]
    df = spark.createDataFrame(rows, "symbol string, " + ", ".join(f"{n} double" for n in names) + ", market_stressed boolean")
    got = {r["symbol"]: r for r in sr.proposals(sr.signals(df, cfg), cfg).collect()}
    for symbol, *values, stressed in rows:
        for k, prev in ((0, 0), (1, 1), (2, 2), (3, 3), (2, 4)):
            label, conf = plain.stock_raw(dict(zip(names, values)), stressed, prev, cfg)
            r = got[symbol]
            assert r[f"raw_{k}"] == label and plain.close(r[f"conf_{k}"], conf, 1e-12), (r, prev)


def _market_history(closes, cfg):
    """Live states of one benchmark, each date computed from its own history."""
    import math
    import statistics as st

    out, prev_rv = [], []
    for i, c in enumerate(closes):
        n = i + 1
        lr = [math.log(b / a) for a, b in zip(closes[max(0, n - 21) : n], closes[max(0, n - 21) + 1 : n])]
        rv = st.stdev(lr) * cfg.annualization if len(lr) == 20 else None
        prev_rv.append(rv)
        known = [x for x in prev_rv[-cfg.vol_lookback :] if x is not None]
        z = None
        if rv is not None and len(known) >= cfg.vol_lookback_min and st.stdev(known) > 0:
            z = (rv - st.fmean(known)) / st.stdev(known)
        dd = plain.drawdown(closes[n - 90 : n]) if n >= 90 else None
        slope = None
        if n >= 50:
            lc = [math.log(x) for x in closes[n - 50 : n]]
            slope = plain.slope(lc) / st.stdev([b - a for a, b in zip(lc, lc[1:])])
        ms, ml = (st.fmean(closes[n - k : n]) if n >= k else None for k in (cfg.ma_short, cfg.ma_long))
        flag = 0 if ms is None or ml is None or ms == ml else 1 if ms > ml else -1
        out.append((z, dd, slope, flag))
    return out


def test_live_regime_equals_plain_history(spark):
    cfg = MarketRegimeConfig()
    closes = plain.walk(330, 21, 0.001, 0.01) + plain.walk(60, 5, -0.008, 0.03, 120.0) + plain.walk(80, 6, 0.002, 0.01, 80.0)
    dates = plain.days(len(closes), dt.date(2019, 1, 1))
    rows = []
    for i, (d, f) in enumerate(zip(dates, _market_history(closes, cfg))):
        props = [plain.market_raw(*f, prev, cfg) for prev in range(4)]
        rows.append((d, [p[0] for p in props], [p[1] for p in props], i + 1 < cfg.min_live_bars))
    want = plain.hysteresis(rows, cfg.confidence_gate, cfg.min_duration, (0, 1, 2, 3), 2)
    got = mr.market_regime(mr.market_features(bars(spark, closes), cfg), cfg).orderBy("date").collect()
    names = ("calm_trend", "calm_trend", "calm_range", "stress")
    for r, (label, conf, n, since) in zip(got, want):
        assert r["label"] == ("calm_range" if label is None else names[label])
        assert plain.close(r["confidence"], conf or 0.0, 1e-9)
        if label is not None:
            assert (r["scores"]["days_in_regime"], r["scores"]["regime_start_date"]) == (n, since)
