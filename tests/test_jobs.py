import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from barframe.config import CommissionConfig, FillConfig, RiskLimits, SlippageConfig
from barframe.operators import inventory as iv
from barframe.operators import learning as ln
from barframe.operators import orders as od
from barframe.sources import bars as sb
from barframe.sources import sinks as sk
from barframe.sources import universe as un
from barframe.streaming import sources as so
from tests import plain

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


def bar_rows(name, n, start=dt.date(2023, 1, 2)):
    return [(name, d, 99.5 + i, 101.0 + i, 99.5 + i, 100.0 + i, 1e6) for i, d in enumerate(plain.days(n, start))]


@pytest.fixture
def files(spark, tmp_path):
    """AAA as Parquet and (other values) CSV, BBB as CSV only, in per-symbol files."""
    def put(rows, name, fmt):
        df = spark.createDataFrame(rows, BARS).drop("symbol").withColumn("timestamp", F.col("date").cast("timestamp")).drop("date")
        pdf = df.toPandas()
        target = tmp_path / f"{name}_1d.{fmt}"
        pdf.to_parquet(target) if fmt == "parquet" else pdf.to_csv(target, index=False)

    put(bar_rows("AAA", 30), "AAA", "parquet")
    put([(s, d, 1.0, 1.0, 1.0, 1.0, 1.0) for s, d, *_ in bar_rows("AAA", 30)], "AAA", "csv")
    put(bar_rows("BBB", 20), "BBB", "csv")
    return str(tmp_path)


def test_read_bars_prefers_parquet(spark, files):
    got = sb.read_bars(spark, files)
    counts = {r["symbol"]: (r["n"], r["c"]) for r in got.groupBy("symbol").agg(F.count("*").alias("n"), F.max("close").alias("c")).collect()}
    assert counts == {"AAA": (30, 129.0), "BBB": (20, 119.0)}
    part = sb.read_bars(spark, files, ["BBB"], "2023-01-05", "2023-01-08")
    assert [r["date"].day for r in part.orderBy("date").collect()] == [5, 6, 7, 8]


def test_read_bars_strict_and_missing(spark, files, tmp_path_factory):
    assert sb.read_bars(spark, files, ["AAA", "ZZZ"]).count() == 30
    with pytest.raises(ValueError):
        sb.read_bars(spark, files, ["AAA", "ZZZ"], strict=True)
    with pytest.raises(FileNotFoundError):
        sb.read_bars(spark, str(tmp_path_factory.mktemp("none")))


def test_standardize_raises_without_a_close(spark):
    df = spark.createDataFrame([(0, 1.0)], "t long, o double")
    with pytest.raises(ValueError):
        sb.standardize(df)
    full = spark.createDataFrame([(86_400_000, 1.0, 2.0, 0.5, 1.5, 10.0, 9.0)], "t long, o double, h double, l double, c double, v double, close double")
    row = sb.standardize(full).first()
    assert row["close"] == 9.0 and row["open"] == 1.0 and row["timestamp"] == dt.datetime(1970, 1, 2)


def test_merge_prefers_new_bars(spark):
    old = spark.createDataFrame(bar_rows("A", 5), BARS)
    new = old.filter("date >= '2023-01-05'").withColumn("close", F.lit(7.0))
    got = {r["date"].day: r["close"] for r in sk.merge_bars(old, new).collect()}
    assert got == {2: 100.0, 3: 101.0, 4: 102.0, 5: 7.0, 6: 7.0}


def test_candles_limits(spark):
    df = spark.createDataFrame(bar_rows("A", 50), BARS)
    got = sb.candles(df, "a", limit=10).collect()
    assert len(got) == 10 and got[-1]["close"] == 149.0 and got[0]["close"] == 140.0
    with pytest.raises(ValueError):
        sb.candles(df, "A", limit=0)


def test_ticker_list(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" aapl \n\nMSFT\n")
    assert [r["symbol"] for r in un.read_universe(spark, str(tmp_path / "t.txt")).collect()] == ["AAPL", "MSFT"]


def test_business_days_equal_numpy(spark):
    rng = random.Random(1)
    rows = [(dt.date(1960, 1, 1) + dt.timedelta(days=rng.randrange(30_000)), rng.randrange(40)) for _ in range(300)]
    df = spark.createDataFrame([(a, a + dt.timedelta(days=k)) for a, k in rows], "a date, b date")
    for r in df.withColumn("n", iv.business_days_after(F.col("a"), F.col("b"))).collect():
        assert r["n"] == np.busday_count(r["a"] + dt.timedelta(days=1), r["b"] + dt.timedelta(days=1))


def test_sync_plan(spark):
    df = spark.createDataFrame(bar_rows("A", 3) + bar_rows("B", 30), BARS)
    uni = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    inv = iv.inventory(df, uni, "2023-02-01")
    got = {r["symbol"]: (r["action"], r["start"]) for r in iv.sync_plan(inv, "2023-02-01").collect()}
    assert got == {"A": ("update", dt.date(2023, 1, 5)), "B": ("skip", None), "C": ("new", dt.date(1970, 1, 1))}
    forced = {r["symbol"]: r["action"] for r in iv.sync_plan(inv, "2023-02-01", force=True).collect()}
    assert forced["B"] == "update"


def test_costs_and_prices(spark):
    row = spark.createDataFrame([("BUY", 100.0, 99.0, 101.0)], "side string, qty double, bid double, ask double")
    slip = SlippageConfig("bps", 10.0)
    got = row.select(od.market_price(FillConfig(), slip).alias("p"),
                     od.commission(F.col("qty"), CommissionConfig("per_share", per_share=0.01, min_commission=2.0)).alias("c")).first()
    assert got["p"] == pytest.approx(101 + 101 * 0.0012) and got["c"] == 2.0
    with pytest.raises(ValueError):
        od.commission(F.col("qty"), CommissionConfig("odd"))
    with pytest.raises(ValueError):
        od.limit_hit(FillConfig(limit_fill_rule="odd"))


def test_ledger_equals_plain_loop(spark):
    rng = random.Random(2)
    rows, cash = [], 100_000.0
    for i in range(300):
        rows.append((i, "acct" if i % 3 else "hot", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), "S", rng.choice(["BUY", "SELL"]), float(rng.randrange(1, 9)), 10.0 + i % 7, 0.5))
    df = spark.createDataFrame(rows, "fill_id long, account_id string, ts timestamp, symbol string, side string, qty double, price double, fee double")
    got = {r["fill_id"]: r["cash"] for r in od.ledger(df).collect()}
    cash = {}
    for i, a, _, _, side, q, p, fee in rows:
        cash[a] = cash.get(a, 100_000.0) + (-(q * p + fee) if side == "BUY" else q * p - fee)
        assert got[i] == pytest.approx(cash[a])


def test_risk_reasons_in_order(spark):
    orders = [(1, "a", "S", "BUY", 10.0), (2, "a", "S", "BUY", 200.0), (3, "b", "S", "BUY", 10.0), (4, "a", "T", "SELL", 1.0), (5, "a", "U", "BUY", 30.0), (6, "busy", "S", "BUY", 1.0)]
    new = spark.createDataFrame(orders, "order_id long, account_id string, symbol string, side string, qty double")
    quotes = spark.createDataFrame([("S", 100.0), ("T", 10.0), ("U", 100.0)], "symbol string, last double")
    acc = spark.createDataFrame([("a", 50_000.0), ("b", 1_500.0)], "account_id string, cash double")
    held = spark.createDataFrame([("a", "U", 290.0)], "account_id string, symbol string, qty double")
    opened = spark.createDataFrame([("busy", 20)], "account_id string, open_orders long")
    got = {r["order_id"]: r["reject_reason"] for r in od.risk_check(new, quotes, acc, held, opened, RiskLimits()).collect()}
    assert got == {1: None, 2: "Trade notional 20000.00 > max_notional_per_trade", 3: "Insufficient cash buffer",
                   4: "Shorting not allowed", 5: "Position limit exceeded", 6: "Too many open orders"}


def test_partial_fills_add_up(spark):
    o = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1), "S", "BUY", 10.0, 5.0)], "order_id long, account_id string, ts timestamp, symbol string, side string, qty double, fill_price double")
    parts = od.split_fills(o, FillConfig(allow_partial_fills=True))
    assert [r["qty"] for r in parts.orderBy("part").collect()] == [6.0, 4.0]
    done = od.roll_up(parts, o).first()
    assert done["status"] == "FILLED" and done["avg_fill_price"] == 5.0
    assert od.roll_up(parts.filter("part = 1"), o).first()["status"] == "PARTIALLY_FILLED"


def labelled(spark, n=160):
    rng = random.Random(8)
    rows = []
    for s in "AB":
        for d in plain.days(n):
            x, z = rng.gauss(0, 1), rng.gauss(3, 2)
            rows.append((s, d, x, z, int(rng.random() < 1 / (1 + np.exp(-(1.5 * x - 0.5 * (z - 3)))))))
    return rows, spark.createDataFrame(rows, "symbol string, date date, x double, z double, y int")


def newton(x, y, c):
    x = np.column_stack([np.ones(len(x)), x])
    pen = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        grad = c * x.T @ (p - y) + pen @ b
        b -= np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + pen, grad)
    return b


def test_logistic_equals_newton(spark):
    rows, df = labelled(spark)
    model = ln.ScaledLogistic(["x", "z"], C=0.5).fit(df)
    raw = np.array([[r[2], r[3]] for r in rows])
    scaled = (raw - raw.mean(0)) / raw.std(0)
    want = newton(scaled, np.array([r[4] for r in rows]), 0.5)
    assert [model.intercept, *model.coefficients] == pytest.approx(list(want), abs=1e-8)


@pytest.mark.parametrize("penalty, balanced", [("l2", None), ("l1", "balanced"), ("elasticnet", "balanced")])
def test_logistic_equals_mllib(spark, penalty, balanced):
    rows, df = labelled(spark)
    model = ln.ScaledLogistic(["x", "z"], C=0.3, penalty=penalty, class_weight=balanced).fit(df)
    ones = sum(r[4] for r in rows)
    w = model._weights(len(rows) - ones, ones)
    d = ln.standardize_apply(df, model.scale, ["x", "z"]).withColumn("w", F.when(F.col("y") == 1, w[1]).otherwise(w[0])).withColumn("label", F.col("y").cast("double"))
    d = VectorAssembler(inputCols=["x", "z"], outputCol="v").transform(d)
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.5}[penalty]
    total = w[0] * (len(rows) - ones) + w[1] * ones
    want = LogisticRegression(featuresCol="v", weightCol="w", regParam=1 / (0.3 * total), elasticNetParam=mix, standardization=False, maxIter=3000, tol=1e-13).fit(d)
    assert [model.intercept, *model.coefficients] == pytest.approx([want.intercept, *want.coefficients], abs=1e-6)


def test_folds_together_equal_folds_alone(spark):
    """Fits, moments and scores of all folds in one pass against one fit per fold; also for a model that knows no folds."""
    rng = random.Random(2)
    rows = [(f"S{i}", d, rng.gauss(3, 2), rng.gauss(0, 9)) for d in plain.days(60) for i in range(4)]
    rows = [(*r, int(rng.random() < 1 / (1 + math.exp(-(r[2] - 3) / 2)))) for r in rows]
    df = spark.createDataFrame(rows, "symbol string, date date, x double, z double, y int")
    folds = ln.walk_forward(df, train=25, test=7, anchored=False)
    together = ln.ScaledLogistic(["x", "z"]).fit_folds(df, folds)
    for f in folds.collect():
        alone = ln.ScaledLogistic(["x", "z"]).fit(df.filter(F.col("date").between(f["train_start"], f["train_end"])))
        got = together[f["fold"]]
        assert [got.intercept, *got.coefficients] == pytest.approx([alone.intercept, *alone.coefficients], abs=1e-9)
        assert got.scale == pytest.approx(alone.scale, abs=1e-12)

    class Own:
        def fit(self, train):
            self.mean = train.agg(F.avg("y")).first()[0]
            return self

        def predict_proba(self, test):
            return test.withColumn("proba", F.lit(self.mean))

    metrics, scored = ln.train_walk_forward(df, folds, lambda: ln.ScaledLogistic(["x", "z"]))
    own, _ = ln.train_walk_forward(df, folds, Own)
    assert scored.count() == 7 * 4 * folds.count()
    assert [r["n_test"] for r in own.orderBy("fold").collect()] == [r["n_test"] for r in metrics.orderBy("fold").collect()] == [28] * folds.count()
    assert ln.train_walk_forward(df, folds, Own, max_folds=2)[0].count() == 2


def test_separable_and_constant_features(spark):
    """A penalty keeps separable data finite; a constant feature gets no weight; one label only gives its certain side."""
    rows = [("A", d, float(i), 5.0, int(i > 19)) for i, d in enumerate(plain.days(40))]
    df = spark.createDataFrame(rows, "symbol string, date date, x double, z double, y int")
    model = ln.ScaledLogistic(["x", "z"], C=10.0).fit(df)
    assert model.coefficients[0] > 1 and model.coefficients[1] == pytest.approx(0, abs=1e-9)
    assert {(r["y"], r["pred"]) for r in model.predict(df).collect()} == {(0, 0), (1, 1)}
    one = ln.ScaledLogistic(["x", "z"], max_iter=40).fit(df.filter("y = 1"))
    assert all(r["proba"] > 0.99 for r in one.predict_proba(df).collect())


def test_model_round_trip(spark, tmp_path):
    _, df = labelled(spark)
    model = ln.ScaledLogistic(["x", "z"], penalty="elasticnet", class_weight="balanced").fit(df)
    model.save(str(tmp_path / "m"))
    again = ln.ScaledLogistic.load(str(tmp_path / "m"))
    key = ["symbol", "date"]
    assert model.predict(df).orderBy(*key).collect() == again.predict(df).orderBy(*key).collect()
    assert again.meta.model_name == "logistic_regression" and again.meta.extra["class_weight"] == "balanced"


def test_metrics_equal_plain(spark):
    rng = random.Random(4)
    rows = [(1, f"S{i}", int(rng.random() < 0.4), round(rng.random(), 1)) for i in range(60)] + [(2, "S", 1, 0.7)]
    got = {r["fold"]: r for r in ln.classification_metrics(spark.createDataFrame(rows, "fold long, symbol string, y int, proba double")).collect()}
    ys, ps = [r[2] for r in rows[:-1]], [r[3] for r in rows[:-1]]
    assert got[1]["auc"] == pytest.approx(plain.auc(ys, ps)) and got[2]["auc"] is None
    assert got[1]["accuracy"] == pytest.approx(np.mean([(p >= 0.5) == y for y, p in zip(ys, ps)]))
    clipped = [min(max(p, 1e-12), 1 - 1e-12) for p in ps]
    assert got[1]["logloss"] == pytest.approx(-np.mean([np.log(p if y else 1 - p) for y, p in zip(ys, clipped)]))


def test_folds_include_one_that_ends_on_the_last_date(spark):
    df = spark.createDataFrame([("A", d, 1.0) for d in plain.days(20)], "symbol string, date date, close double")
    got = ln.walk_forward(df, train=10, test=5, gap=0).orderBy("fold").collect()
    assert [(r["train_start"].day, r["train_end"].day, r["test_start"].day, r["test_end"].day) for r in got] == [(1, 10, 11, 15), (1, 15, 16, 20)]
    rolling = ln.walk_forward(df, train=10, test=5, anchored=False).orderBy("fold").collect()
    assert rolling[1]["train_start"].day == 6
    with pytest.raises(ValueError):
        ln.walk_forward(df, train=19, test=5)


def test_label_modes(spark):
    df = spark.createDataFrame([("A", d, c) for d, c in zip(plain.days(3), [1.0, 2.0, 1.0])], "symbol string, date date, close double")
    assert [r["y"] for r in ln.next_day_label(df).orderBy("date").collect()] == [1, 0]
    assert [r["y"] for r in ln.next_day_label(df, "compat").orderBy("date").collect()] == [0, 1, 0]


def test_stream_dedupe_drops_repeats(spark, tmp_path):
    rows = [(i % 5, dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(20)]
    spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = so.stream_dedupe(spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in")), ["id"], "1 hour")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
