"""Keyed operators on streams: features with late and corrected bars, warm start."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barframe.operators import features as ft
from barframe.streaming import incremental as ic
from barframe.streaming import timers as tm
from barframe.streaming.state import PROVIDER, rocksdb
from tests import plain

BARS = "symbol string, date date, close double, volume double"
DAY0 = dt.date(1970, 1, 1)


class Box:
    """A state variable in memory."""

    def __init__(self):
        self.value = []

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def put(self, rows):
        self.value = rows

    update = put

    def exists(self):
        return self.value != []


class Handle:
    def getListState(self, name, schema):
        return Box()

    getValueState = getListState


def processor(revise):
    p = ic.FeatureProcessor(revise)
    p.init(Handle())
    return p


def feed(p, rows, name="A"):
    """Rows (date, close, volume) as one batch; what the processor emits."""
    pdf = pd.DataFrame([(name, (d - DAY0).days, c, v) for d, c, v in rows], columns=["symbol", "at", "close", "volume"])
    return [r for out in p.handleInputRows((name,), iter([pdf]), None) for r in out.to_dict("records")]


def batch(spark, rows):
    df = spark.createDataFrame([("A", *r) for r in rows], BARS)
    return {(r["date"] - DAY0).days: r for r in ft.features(df, keep=("close", "volume")).collect()}


def same(got, want):
    assert got["n"] == want["n"]
    for f in ft.FEATURES:
        if want[f] is None:
            assert not np.isfinite(got[f]), (f, got["n"], got[f])
        else:
            assert got[f] == pytest.approx(want[f], rel=1e-8, abs=1e-11), (f, got["n"])


@pytest.fixture(scope="module")
def history():
    closes = plain.walk(900, 3)
    for i in [*range(100, 112), 400, 401, 560]:
        closes[i] = None
    for i in range(600, 640):
        closes[i] = 50.0
    return [(d, c, 5.0 + i % 7) for i, (d, c) in enumerate(zip(plain.days(900), closes))]


def test_ordered_bars_give_the_batch_features(spark, history):
    want, p, seen = batch(spark, history), processor(0), 0
    for lo in range(0, 900, 37):
        for r in feed(p, history[lo : lo + 37]):
            same(r, want[r["at"]])
            assert r["version"] and not r["late"]
            seen += 1
    assert seen == 900 and len(p.bars.value) == ic.REACH and len(p.older.value) == ft.RV20_HISTORY


def test_late_and_corrected_bars_are_merged(spark, history):
    rng = random.Random(8)
    rows, kept = [], {}
    for i, (d, c, v) in enumerate(history):
        at = i + (rng.randrange(1, 40) if i % 9 == 0 else 0)
        rows.append((at, (d, c, v)))
        if i % 50 == 7:  # first with smaller values, later as it is
            rows.append((i - 0.5, (d, c and c / 2, v / 2)))
            rows[-2] = (i + 20, rows[-2][1])
        if i % 31 == 0:
            rows.append((at + 15, (d, c, v)))
    rows = [r for _, r in sorted(rows, key=lambda x: x[0])]
    p = processor(64)
    for lo in range(0, len(rows), 10):
        for r in feed(p, rows[lo : lo + 10]):
            assert not r["late"] and (r["at"] not in kept or kept[r["at"]]["version"] < r["version"])
            kept[r["at"]] = r
    want = batch(spark, history)
    assert kept.keys() == want.keys()
    for at, r in kept.items():
        same(r, want[at])


def test_only_rows_from_the_late_bar_on_are_emitted_again(history):
    p = processor(64)
    days = [r for i, r in enumerate(history[:500]) if i != 480]
    feed(p, days)
    out = feed(p, [history[480]])
    assert [r["at"] for r in out] == [(d - DAY0).days for d, *_ in history[480:500]] and {r["version"] for r in out} == {2}
    assert feed(p, [history[490], history[480]]) == []


def test_bars_beyond_the_kept_list_are_set_aside(history):
    p = processor(10)
    feed(p, [r for i, r in enumerate(history[:600]) if i != 300])
    out = feed(p, [history[300], history[600], history[301]])
    assert [(r["at"], r["late"]) for r in out] == [((history[600][0] - DAY0).days, False), ((history[300][0] - DAY0).days, True), ((history[301][0] - DAY0).days, True)][: len(out)]
    assert [r["late"] for r in out].count(False) == 1 and all(pd.isna(r["mom5"]) for r in out if r["late"])


def test_warm_start_equals_one_run(spark, history):
    p = processor(16)
    start = ic.end_state(spark.createDataFrame([("A", *r) for r in history[:700]], BARS), 16).toPandas()
    p.handleInitialState(("A",), start, None)
    whole = processor(16)
    feed(whole, history[:700])
    for a, b in ((p.bars.value, whole.bars.value), (p.older.value, whole.older.value)):
        assert np.allclose(np.array(a, dtype=float), np.array(b, dtype=float), equal_nan=True, rtol=1e-9, atol=1e-13)
    assert p.head.value[0] == whole.head.value[0]
    want = batch(spark, history)
    for r in feed(p, history[700:]):
        same(r, want[r["at"]])


def test_stream_needs_the_state_store(spark, tmp_path):
    spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0, 1.0)], BARS).write.parquet(str(tmp_path / "in"))
    bars = spark.readStream.schema(BARS).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        ic.stream_features(bars)
    with rocksdb(spark):
        q = ic.stream_features(bars).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        q.trigger(availableNow=True).start().awaitTermination()
    assert spark.conf.get(PROVIDER, None) is None or "RocksDB" not in spark.conf.get(PROVIDER)
    rows = ic.newest(spark.read.parquet(str(tmp_path / "out"))).filter(F.col("close") == 1.0).collect()
    assert [(r["n"], r["version"], r["ret1"]) for r in rows] == [(1, 1, None)]


def started(stream, tmp_path, name="out"):
    w = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck"))
    return w.trigger(processingTime="500 milliseconds").start()


def test_a_silent_symbol_raises_an_alarm_by_the_wall_clock(spark, tmp_path):
    """B gets no further event: only the timer can report it. Its next event ends the alarm."""
    schema, feed, t0 = "symbol string, ts timestamp", str(tmp_path / "in"), dt.datetime(2024, 1, 1)

    def put(second, *names):
        spark.createDataFrame([(n, t0 + dt.timedelta(seconds=second)) for n in names], schema).coalesce(1).write.mode("append").parquet(feed)

    def alarms():
        return [(r["symbol"], (r["last_ts"] - t0).seconds, r["stale"]) for r in spark.read.schema("symbol string, last_ts timestamp, stale boolean").parquet(str(tmp_path / "out")).collect()]

    put(0, "A", "B")
    with rocksdb(spark):
        q = started(tm.stream_silence(spark.readStream.schema(schema).parquet(feed), 8.0, "wall"), tmp_path)
        end, k, found = time.time() + 60, 0, []
        while time.time() < end and ("B", 50, False) not in found:
            k += 1
            put(k, "A")
            if k < 100 and ("B", 0, True) in found:
                put(50, "B")
                k = 100
            time.sleep(1)
            found = alarms() if (tmp_path / "out" / "_spark_metadata").exists() else []
        q.stop()
    assert sorted(a for a in found if a[0] == "B") == [("B", 0, True), ("B", 50, False)]


def test_dates_are_emitted_whole_and_once(spark, tmp_path):
    """Rows of a date from several files and buckets come out together; a row after the watermark is left out."""
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 8)]
    files = [[(f"S{i}", days[0], float(i)) for i in range(6)], [(f"S{i}", days[0], float(i)) for i in range(4, 10)] + [("S1", days[1], 1.0)],
             [("S2", days[2], None), (None, days[3], None)], [("S99", days[0], 5.0), (None, dt.date(2024, 1, 20), None)]]
    feed, out, check = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "symbol string, date date, close double"
    with rocksdb(spark):
        for rows in files:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)
            tm.stream_cross_section(spark.readStream.schema(schema).parquet(feed), out, check, ["close"], buckets=3).awaitTermination()
    got = {(r["date"], r["symbol"]): r for r in spark.read.parquet(out).collect()}
    assert sorted(s for d, s in got if d == days[0]) == [f"S{i}" for i in range(10)] and len(got) == 12
    assert [got[days[0], f"S{i}"]["close_rank"] for i in (0, 9)] == [0.0, 1.0] and got[days[1], "S1"]["close_rank"] == 0.5
    assert got[days[0], "S0"]["close_z"] == pytest.approx(-4.5 / np.std(range(10)))
