import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barframe.functions import windows as wf
from barframe.operators import features as ft
from barframe.operators import panel as pn
from barframe.plans import segments as sg
from tests import plain

SCHEMA = "symbol string, date date, close double, volume double"


def series(n, seed):
    return plain.walk(n, seed), [1000.0 + 10 * (i % 17) for i in range(n)]


def rows_of(name, closes, volumes, start=dt.date(2020, 1, 1)):
    return [(name, d, c, v) for d, c, v in zip(plain.days(len(closes), start), closes, volumes)]


@pytest.fixture(scope="module")
def awkward():
    """Symbols with gaps, missing and zero prices, a flat stretch and few bars."""
    a, va = series(420, 1)
    b, vb = series(400, 2)
    for i in (30, 31, 95, 200):
        b[i] = None
    for i in range(120, 130):
        b[i] = 0.0
    c, vc = series(330, 3)
    for i in range(40, 110):
        c[i] = c[40]
    d, vd = series(15, 4)
    return {"A": (a, va), "B": (b, vb), "C": (c, vc), "D": (d, vd)}


@pytest.mark.parametrize("rows", [sg.SEGMENT_ROWS, 300])
def test_features_equal_plain_rules(spark, awkward, rows):
    data = [r for name, (c, v) in awkward.items() for r in rows_of(name, c, v)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["symbol"], r["n"]): r for r in ft.features(df, rows=rows).collect()}
    assert len(got) == len(data)
    for name, (closes, volumes) in awkward.items():
        for i, want in enumerate(plain.features(closes, volumes)):
            row = got[(name, i + 1)]
            for f in ft.FEATURES:
                tol = 1e-6 if f in ("rv20_z", "dev20", "normalized_slope") else 1e-9
                if name in "BC" and f in ("rv20_z", "dev20", "normalized_slope") and _tiny_vol(closes, i):
                    continue  # volatility of a flat stretch is rounding noise on both sides
                assert plain.close(row[f], want[f], tol), (name, i, f, row[f], want[f])


def _tiny_vol(closes, i):
    w = [x for x in closes[max(0, i - 60) : i + 1] if x]
    return any(len(set(w[k : k + 19])) == 1 for k in range(max(1, len(w) - 18)))


def test_linear_prices_closed_form(spark):
    closes = [100.0 + i for i in range(80)]
    got = ft.features(spark.createDataFrame(rows_of("A", closes, [1e6] * 80), SCHEMA)).orderBy("n").collect()
    assert got[62]["mom63"] is None
    assert got[63]["mom63"] == pytest.approx(163 / 100 - 1)
    assert got[18]["sma20"] is None and got[19]["sma20"] == pytest.approx(109.5)
    assert got[0]["ret1"] is None and got[1]["ret1"] == pytest.approx(0.01)


def test_each_feature_alone_keeps_its_own_lookback(spark):
    closes, volumes = series(120, 9)
    df = spark.createDataFrame(rows_of("A", closes, volumes), SCHEMA)
    alone = ft.features(df, ["mom63"]).orderBy("n").collect()
    assert alone[63]["mom63"] == pytest.approx(closes[63] / closes[0] - 1)


def test_no_look_ahead(spark):
    closes, volumes = series(300, 5)
    cut = 250
    changed = closes[:cut] + [c * 3 for c in closes[cut:]]
    a = ft.features(spark.createDataFrame(rows_of("A", closes, volumes), SCHEMA)).filter(F.col("n") <= cut)
    b = ft.features(spark.createDataFrame(rows_of("A", changed, volumes), SCHEMA)).filter(F.col("n") <= cut)
    cols = ["n", *ft.FEATURES]
    assert a.select(cols).orderBy("n").collect() == b.select(cols).orderBy("n").collect()


def test_unknown_feature_and_missing_input_raise(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0)], "symbol string, date date, close double")
    with pytest.raises(ValueError):
        ft.features(df, ["nope"])
    with pytest.raises(ValueError):
        ft.features(df, ["adv20"])


def test_custom_feature_really_computes(spark):
    cat = ft.default_catalogue()
    cat.add(ft.FeatureSpec("mom2", 2, ("close",), lambda w: F.col("close") / F.lag("close", 2).over(w) - 1))
    closes, volumes = series(10, 6)
    out = ft.features(spark.createDataFrame(rows_of("A", closes, volumes), SCHEMA), ["mom2"], catalogue=cat)
    assert out.orderBy("n").collect()[5]["mom2"] == pytest.approx(closes[5] / closes[3] - 1)


@pytest.mark.parametrize("rows", [1_000_000, 10])
def test_numbered_and_running_sum(spark, rows):
    data = [(k, plain.days(1, dt.date(1999, 12, 20) + dt.timedelta(days=9 * i))[0], float(i % 5)) for k in "AB" for i in range(200)]
    df = spark.createDataFrame(data, "symbol string, date date, x double")
    got = sg.running_sum(sg.numbered(df, "symbol", "date"), "symbol", "date", F.col("x"), "s", rows=rows).collect()
    for name in "AB":
        mine = sorted((r for r in got if r["symbol"] == name), key=lambda r: r["date"])
        assert [r["n"] for r in mine] == list(range(1, 201))
        total = 0.0
        for r in mine:
            total += r["x"]
            assert r["s"] == pytest.approx(total)


def test_ewma_poisoned_by_missing_value(spark):
    xs = [1.0, 2.0, None, 3.0]
    df = spark.createDataFrame(list(zip("AAAA", plain.days(4), xs)), "symbol string, date date, x double")
    got = [r["ewma"] for r in wf.ewma(df, "x", 0.5).orderBy("date").collect()]
    assert got == [1.0, 1.5, None, None]


def test_panel_carries_whole_rows(spark):
    d = plain.days(6)
    data = [("A", d[0], 1.0, 1.0), ("A", d[2], 2.0, 1.0), ("B", d[1], 5.0, 1.0), ("B", d[5], 6.0, 1.0), ("A", d[5], 4.0, 1.0)]
    df = spark.createDataFrame(data, SCHEMA)
    feats = ft.features(df, ["ret1"])
    cal = pn.calendar(df)
    pan = {(r["date"], r["symbol"]): r for r in pn.panel(feats, cal, ["close", "ret1"]).collect()}
    assert len(pan) == 4 * 2  # four trading dates, two symbols
    assert pan[(d[1], "A")]["close"] == 1.0 and not pan[(d[1], "A")]["fresh"]
    assert pan[(d[0], "B")]["close"] is None and pan[(d[0], "B")]["n"] == 0
    assert pan[(d[2], "B")]["ret1"] is None and pan[(d[2], "B")]["close"] == 5.0
    assert pan[(d[5], "B")]["ret1"] == pytest.approx(0.2)


def test_ready_date_waits_for_the_threshold(spark):
    data = [r for i, name in enumerate("ABCDE") for r in rows_of(name, *series(30, i), start=dt.date(2020, 1, 1) + dt.timedelta(days=i))]
    feats = ft.features(spark.createDataFrame(data, SCHEMA), ["ret1"])
    got = pn.ready_date(feats, warmup=10, threshold=0.8).first()["ready_date"]
    assert got == dt.date(2020, 1, 1) + dt.timedelta(days=3 + 9)


def test_emit_every(spark):
    closes, volumes = series(20, 1)
    cal = pn.calendar(spark.createDataFrame(rows_of("A", closes, volumes), SCHEMA))
    got = [r["date"] for r in pn.emit_dates(cal, "2020-01-06", 5).orderBy("date").collect()]
    assert got == [dt.date(2020, 1, 10), dt.date(2020, 1, 15), dt.date(2020, 1, 20)]


def test_rolling_std_needs_more_values_than_ddof(spark):
    df = spark.createDataFrame([("A", x, float(i)) for i, x in enumerate(plain.days(3))], "symbol string, date date, x double")
    got = wf.roll(df, {"s": ("x", 2, "std")}, ddof=1).orderBy("date").collect()
    assert got[0]["s"] is None and got[1]["s"] == pytest.approx(math.sqrt(0.5))
