"""Registered queries: one or more per operator, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barframe import demo
from barframe.config import AlphaConfig, MarketRegimeConfig
from barframe.functions import scalar as sc
from barframe.functions import windows as wf
from barframe.operators import alpha as al
from barframe.operators import cleaning as cl
from barframe.operators import features as ft
from barframe.operators import market_regime as mr
from barframe.operators import panel as pn
from barframe.operators import stock_regime as sr
from barframe.operators import xsection as xs
from barframe.plans.settle import new_path
from barframe.sources import bars as sb
from barframe.sources import history as hs
from barframe.sources import resample as rs
from barframe.sources import sinks as sk
from barframe.sources import universe as un
from workload import inputs as inp
from workload import sql as q

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    ids: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def add(name: str, ids: str, run: Run, sql: str | None = None) -> None:
    REGISTRY[name] = Entry(ids, run, sql)


# Averages over 200 rows of four-digit prices end on a half at the sixth digit; they are kept to the eighth.
FINE = {"sma200": 8, "ma_long": 8, "ratio": 10, "slip": 12}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so sums taken in another order compare equal; -0.0 becomes 0.0."""
    cols = [
        (F.round(F.col(f.name), FINE.get(f.name, digits)) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {FINE.get(n, digits)}) + 0e0 AS {n.split('.')[-1]}" for n in names)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


B = inp.bars
OHLCV = "open, high, low, close, volume"

# --- sources and sinks -------------------------------------------------------------------------------------
add("derive_bars", "S1", lambda s, d: demo.derive_brand_bars(s, d), q.build(f"SELECT symbol, date, {OHLCV} FROM bars", "bars"))


def _read_parquet(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "bar-files")
    sk.write_bars(B(s, d).withColumn("month", F.date_format("date", "yyyy-MM")), path, partition_by=["month"])
    return sb.read_bar_table(s, path, "1996-01-01", "1999-12-31")


add("read_parquet_bars", "S1 K1 B5", _read_parquet,
    q.build(f"SELECT symbol, date, {OHLCV} FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", "bars"))


def _read_csv(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "bar-csv")
    sk.write_bars(B(s, d), path, "csv")
    raw = s.read.option("header", "true").csv(path)
    return raw.select("symbol", F.to_date("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in OHLCV.split(", ")])


add("read_csv_bars", "S2 K2", _read_csv, q.build(f"SELECT symbol, date, {OHLCV} FROM bars", "bars"))
def _symbol_files(s: SparkSession, d: str) -> str:
    """The bars as one file per symbol: Parquet with standard or vendor names, CSV with two column orders, and both kinds at once."""
    path, raw = new_path(s, "symbol-files"), new_path(s, "symbol-parts")
    jvm, b = s.sparkContext._jvm, B(s, d).select("symbol", "date", *OHLCV.split(", "))
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    number = F.regexp_extract("symbol", "[0-9]+$", 0).cast("int")
    plain = b.withColumn("timestamp", F.col("date").cast("timestamp")).drop("date")
    vendor = plain.select("symbol", F.unix_millis("timestamp").alias("t"), *[F.col(c).alias(c[0]) for c in OHLCV.split(", ")])
    lines = b.select("symbol", F.col("date").alias("timestamp"), *OHLCV.split(", "))
    kinds = [
        ("standard", "parquet", plain.filter(number % 4 == 0)),
        ("vendor", "parquet", vendor.filter(number % 4 == 1)),
        ("csv", "csv", lines.filter(number % 4 == 2)),
        ("shuffled", "csv", lines.select("volume", "close", "symbol", "low", "timestamp", "open", "high").filter(number % 4 == 3)),
        # Copies that must lose against Parquet.
        ("loser", "csv", lines.withColumn("close", F.lit(1.0)).filter(number % 8 == 0)),
    ]
    for kind, fmt, rows in kinds:
        rows.repartition(1).write.partitionBy("symbol").option("header", "true").format(fmt).save(f"{raw}/{kind}")
        for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{raw}/{kind}/symbol=*/part-*")):
            name = unquote(f.getPath().getParent().getName().split("=")[1])
            target = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/{name}_1d.{fmt}")
            fs.mkdirs(target.getParent())
            fs.rename(f.getPath(), target)
    return path


add("read_symbol_files", "S1 S2 S3 B1", lambda s, d: sb.read_bars(s, _symbol_files(s, d)), q.build(f"SELECT symbol, date, {OHLCV} FROM bars", "bars"))
add("prefer_parquet", "S3",
    lambda s, d: sb.prefer(
        B(s, d).filter(F.col("date") < "1998-01-01").filter(~F.col("symbol").endswith("5")).select("symbol", "date", "close"),
        B(s, d).select("symbol", "date", (F.col("close") + 0.0).alias("close"))),
    q.build("""SELECT symbol, date, close FROM bars WHERE (symbol LIKE '%5') OR date < DATE '1998-01-01'""", "bars"))


def _ticker_lines(s: SparkSession, d: str) -> DataFrame:
    return demo.table(s, d, "part").select(F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" ")).alias("value"))


add("ticker_list", "S6", lambda s, d: un.parse_tickers(_ticker_lines(s, d)).distinct(),
    "SELECT DISTINCT upper(trim(p_brand)) AS symbol FROM part WHERE trim(p_brand) <> ''")
add("list_symbols", "S7", lambda s, d: un.list_symbols(B(s, d)), q.build("SELECT DISTINCT symbol FROM bars", "bars"))


def _part_universe(s: SparkSession, d: str) -> DataFrame:
    p = demo.table(s, d, "part")
    return p.groupBy(F.col("p_brand").alias("symbol")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 80)


_UNI = "SELECT p_brand AS symbol FROM part GROUP BY 1 HAVING count(*) >= 80"
add("load_universe", "S4 S5 B9 J4", lambda s, d: sb.load_universe(B(s, d), _part_universe(s, d)),
    q.build(f"SELECT symbol, date, {OHLCV} FROM bars WHERE symbol IN ({_UNI})", "bars"))
add("missing_symbols", "J5 R6",
    lambda s, d: sb.missing_symbols(B(s, d).filter(F.col("date") < "1995-01-04"), demo.universe(s, d)),
    q.build("SELECT DISTINCT p_brand AS symbol FROM part WHERE p_brand NOT IN (SELECT symbol FROM bars WHERE date < DATE '1995-01-04')", "bars"))
add("common_symbols", "R6",
    lambda s, d: demo.universe(s, d).intersect(B(s, d).filter(F.col("date") < "1995-01-04").select("symbol")),
    q.build("SELECT p_brand AS symbol FROM part INTERSECT SELECT symbol FROM bars WHERE date < DATE '1995-01-04'", "bars"))
add("candles", "S8 R3",
    lambda s, d: sb.candles(B(s, d).withColumn("symbol", F.upper("symbol")), "Brand#7", "1996-01-01", "2000-06-30", 500),
    q.build(f"""SELECT upper(symbol) AS symbol, date, {OHLCV} FROM bars WHERE symbol = 'Brand#7'
      AND date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30' ORDER BY date DESC LIMIT 500""", "bars"))
_TICK_SQL = """SELECT event_type AS symbol, time_bucket(INTERVAL '{every}', CAST(ts AS TIMESTAMP)) AS start,
  time_bucket(INTERVAL '{every}', CAST(ts AS TIMESTAMP)) + INTERVAL '{every}' AS "end",
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  CAST(count(*) AS DOUBLE) AS volume, count(*) AS trades FROM events GROUP BY 1, 2"""
add("resample_hour", "S11 T4", lambda s, d: rs.resample(demo.ticks(s, d), "1 hour", tie="event_id"), _TICK_SQL.format(every="1 hour"))
add("resample_day", "S11", lambda s, d: rs.resample(demo.ticks(s, d), "1 day", tie="event_id"), _TICK_SQL.format(every="1 day"))
add("resample_sliding", "S11 T4",
    lambda s, d: rs.resample(demo.ticks(s, d), "6 hours", "2 hours", tie="event_id").drop("end"),
    """SELECT symbol, start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS trades FROM (
       SELECT event_type AS symbol, value, event_id, CAST(ts AS TIMESTAMP) AS ts,
         time_bucket(INTERVAL '2 hours', CAST(ts AS TIMESTAMP)) - INTERVAL '2 hours' * unnest([0, 1, 2]) AS start FROM events)
       GROUP BY 1, 2""")


def _updates(s: SparkSession, d: str) -> DataFrame:
    late = B(s, d).filter(F.col("date") >= "2000-01-01")
    return late.withColumns({"date": F.date_add("date", 30), "close": F.round(F.col("close") * 1.01, 6)})


add("merge_bars", "K3 R5", lambda s, d: sk.merge_bars(B(s, d), _updates(s, d)).select("symbol", "date", "close", "volume"),
    q.build("""SELECT symbol, date, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY prio DESC) AS k FROM (
      SELECT symbol, date, close, volume, 0 AS prio FROM bars UNION ALL
      SELECT symbol, date + 30, round(close * 101e-2, 6), volume, 1 FROM bars WHERE date >= DATE '2000-01-01')) WHERE k = 1""", "bars"))


def _upsert(s: SparkSession, d: str, fmt: str = "parquet") -> DataFrame:
    path = new_path(s, "history")
    year = lambda df: df.withColumn("year", F.year("date"))
    hs.upsert_history(s, path, year(B(s, d)), "year")
    hs.upsert_history(s, path, year(_updates(s, d)), "year")
    return hs.read_history(s, path, fmt).select("symbol", "date", "open", "high", "low", "close", "volume", F.col("year").cast("long").alias("year"))


_UPSERT = q.build("""SELECT symbol, date, open, high, low, close, volume, CAST(year(date) AS BIGINT) AS year FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY prio DESC) AS k FROM (
      SELECT symbol, date, open, high, low, close, volume, 0 AS prio FROM bars UNION ALL
      SELECT symbol, date + 30, open, high, low, round(close * 101e-2, 6), volume, 1 FROM bars WHERE date >= DATE '2000-01-01')) WHERE k = 1""", "bars")
add("upsert_bars", "K3", lambda s, d: _upsert(s, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 6).alias("total")),
    "SELECT year, count(*) AS n, round(sum(close), 6) AS total FROM (" + _UPSERT + ") GROUP BY 1")
add("upsert_bars_parquet", "K3 K1", _upsert, _UPSERT)
add("upsert_bars_csv", "K3 K2", lambda s, d: _upsert(s, d, "csv"), _UPSERT)


def _json(s: SparkSession, d: str) -> DataFrame:
    j = sk.to_json_column(inp.stock_rule(s, d), ["symbol", "date", "label", "confidence"])
    back = sk.from_json_column(j.select("json"), inp.stock_rule(s, d).schema)
    return rounded(back.select("symbol", "date", "label", "confidence"))


add("json_round_trip", "K4", _json, q.build(f"SELECT symbol, date, label, {r('confidence')} FROM stock_rule", "stock_rule"))

# --- cleaning ----------------------------------------------------------------------------------------------


def _vendor(s: SparkSession, d: str) -> DataFrame:
    ms = (F.unix_timestamp(F.col("date").cast("timestamp")) * 1000 + 18_000_000).cast("long")
    return B(s, d).select("symbol", ms.alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
                          F.col("close").alias("c"), F.col("volume").alias("v"), (F.col("close") + 0.5).alias("vw"), F.lit(3).alias("n"))


add("standardize_vendor", "B1 B2 B3 B6", lambda s, d: sb.drop_vendor(sb.normalize_date(sb.standardize(_vendor(s, d)))),
    q.build(f"SELECT symbol, CAST(date AS TIMESTAMP) + INTERVAL '5 hours' AS timestamp, {OHLCV}, date FROM bars", "bars"))
_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem"
add("dedupe_last", "B4",
    lambda s, d: sb.dedupe_last(demo.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"),
                                ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]),
    f"""SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS k FROM ({_LINES})) WHERE k = 1""")
add("date_range", "B5", lambda s, d: sb.between_dates(B(s, d), "1997-03-01", "1997-03-31").select("symbol", "date", "close"),
    q.build("SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'", "bars"))
add("select_features", "B7 B8",
    lambda s, d: rounded(cl.drop_incomplete(cl.select_features(inp.feats(s, d), ["mom63", "rv20", "rv20_z"], ["symbol", "date", "rv20"]), ["mom63", "rv20", "rv20_z"])),
    q.build(f"SELECT symbol, date, {r('rv20', 'mom63', 'rv20_z')} FROM feats WHERE mom63 IS NOT NULL AND rv20 IS NOT NULL AND rv20_z IS NOT NULL", "feats"))
add("stock_flags", "B12", lambda s, d: cl.stock_flags(inp.stock_rule(s, d)).drop("confidence"),
    q.build("""SELECT symbol, date, label, label <> 'no_trade' AS is_tradeable, label IN ('trending_up', 'trending_down') AS is_trending,
      label = 'trending_up' AS is_trending_up, label = 'trending_down' AS is_trending_down, label = 'range_low_vol' AS is_ranging,
      label = 'stressed_high_vol' AS is_stressed FROM stock_rule""", "stock_rule"))
add("market_flags", "B12", lambda s, d: cl.market_flags(inp.market_rule(s, d)).drop("confidence"),
    q.build("""SELECT date, label, label IN ('stress', 'crisis') AS is_stressed, label IN ('calm_trend', 'calm_range') AS is_calm,
      label = 'calm_trend' AS is_trending FROM market_rule""", "market_rule"))
add("filter_regimes", "B11",
    lambda s, d: rounded(cl.filter_confidence(cl.filter_tradeable(inp.stock_rule(s, d)), 0.7)).unionByName(
        rounded(cl.filter_label(inp.stock_rule(s, d), "no_trade"))),
    q.build(f"SELECT symbol, date, label, {r('confidence')} FROM stock_rule WHERE (label <> 'no_trade' AND confidence >= 7e-1) OR label = 'no_trade'", "stock_rule"))

# --- windows -----------------------------------------------------------------------------------------------
_ROLL = {"mean10": ("close", 10, "mean"), "std10": ("close", 10, "std"), "sum10": ("volume", 10, "sum"), "min10": ("close", 10, "min"),
         "max10": ("close", 10, "max"), "last10": ("close", 10, "last")}
_RW = "OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)"
_ROLL_SQL = f"""SELECT symbol, date, round(avg(close) {_RW}, 6) AS mean10, round(stddev_pop(close) {_RW}, 6) + 0e0 AS std10,
  round(sum(volume) {_RW}, 6) AS sum10, round(min(close) {_RW}, 6) AS min10, round(max(close) {_RW}, 6) AS max10, close AS last10 FROM bars"""
add("rolling", "W1 W2 W3 W4 W5",
    lambda s, d: rounded(wf.roll(B(s, d), _ROLL).select("symbol", "date", *_ROLL)), q.build(_ROLL_SQL, "bars"))
add("rolling_in_segments", "W1 W2 W3 W4 W5",
    lambda s, d: rounded(wf.roll(B(s, d), _ROLL, rows=256).select("symbol", "date", *_ROLL)), q.build(_ROLL_SQL, "bars"))


def _ready(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    return rounded(B(s, d).select("symbol", "date", wf.ready(w, "close", 30).alias("ready"),
                                  wf.rolling(w, "close", 30, "std", full=True, ddof=1).alias("std30"),
                                  F.size(wf.rolling(w, "close", 30, "values")).cast("long").alias("held")))


add("window_ready", "W2 W5 W6", _ready,
    q.build("""SELECT symbol, date, count(*) OVER w = 30 AS ready, CASE WHEN count(*) OVER w = 30 THEN round(stddev_samp(close) OVER w, 6) END AS std30,
      count(*) OVER w AS held FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING)""", "bars"))
_EWMA_SQL = """, e AS (SELECT symbol, n, date, close AS v FROM f1 WHERE n = 1 UNION ALL
  SELECT f1.symbol, f1.n, f1.date, 1e-1 * f1.close + 9e-1 * e.v FROM e JOIN f1 ON f1.symbol = e.symbol AND f1.n = e.n + 1)
SELECT symbol, date, CASE WHEN n >= 10 THEN round(v, 6) END AS ewma FROM e"""
_EWMA = q.build("", "f1").rstrip() + _EWMA_SQL
add("ewma", "W7", lambda s, d: rounded(wf.ewma(B(s, d).select("symbol", "date", "close"), "close", 0.1, 10).drop("close")), _EWMA)
add("ewma_in_segments", "W7",
    lambda s, d: rounded(wf.ewma(B(s, d).select("symbol", "date", "close"), "close", 0.1, 10, rows=200).drop("close")), _EWMA)
add("scalar_helpers", "W8 W9 D6",
    lambda s, d: rounded(B(s, d).select("symbol", "date", sc.safe_div(F.col("close"), F.col("volume") - 30).alias("ratio"),
                                        sc.clip("close", 80, 120).alias("clipped"), sc.clamp01(F.col("close") / 100 - 0.5).alias("unit"),
                                        sc.keep_positive(F.col("close") - 100).alias("above"))),
    q.build("""SELECT symbol, date, CASE WHEN volume - 30 <> 0 THEN round(close / (volume - 30), 10) END AS ratio,
      round(greatest(80e0, least(120e0, close)), 6) AS clipped, round(greatest(0e0, least(1e0, close / 1e2 - 5e-1)), 6) AS unit,
      round(greatest(close - 100, 0e0), 6) AS above FROM bars""", "bars"))


def _cumulative(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    b = B(s, d).withColumn("ret", wf.lag_return(w))
    return rounded(b.select("symbol", "date", "ret", F.product(F.coalesce(F.col("ret"), F.lit(0.0)) + 1).over(run).alias("growth"),
                            F.max("close").over(run).alias("peak")))


add("cumulative", "W10", _cumulative,
    q.build("""SELECT symbol, date, round(ret, 6) + 0e0 AS ret, round(product(coalesce(ret, 0e0) + 1) OVER w, 6) AS growth, round(max(close) OVER w, 6) AS peak
      FROM f2 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)""", "f2"))

# --- features and panel ------------------------------------------------------------------------------------


def _feature(name: str, digits: int = 6) -> None:
    add(f"feature_{name}", "F" + str(["ret1", "mom5", "mom21", "mom63", "sma20", "sma50", "sma200", "trend_gap", "rv20", "rv60", "rv20_z",
                                      "adv20", "dev20", "max_dd_90", "normalized_slope"].index(name) + 1) + " F0 F16",
        lambda s, d: rounded(ft.features(B(s, d), [name]).select("symbol", "date", name), digits),
        q.build(f"SELECT symbol, date, {r(name, digits=digits)} FROM feats", "feats"))


for _name in ft.FEATURES:
    _feature(_name)
_FEATS_SQL = q.build(f"SELECT symbol, date, n, {r(*ft.FEATURES)} FROM feats", "feats")


def _feature_table(df: DataFrame) -> DataFrame:
    return rounded(df.select("symbol", "date", "n", *ft.FEATURES))


add("feature_table", "F1-F15", lambda s, d: _feature_table(ft.features(B(s, d))), _FEATS_SQL)
add("feature_table_in_segments", "F1-F15", lambda s, d: _feature_table(ft.features(B(s, d), rows=400)), _FEATS_SQL)


def _custom(s: SparkSession, d: str) -> DataFrame:
    """A catalogue extended by a user's own features."""
    cat = ft.default_catalogue()
    cat.add(ft.FeatureSpec("mom10", 10, ("close",), lambda w: F.col("close") / F.lag("close", 10).over(w) - 1))
    cat.add(ft.FeatureSpec("range5", 5, ("high", "low"), lambda w: F.max("high").over(w.rowsBetween(-4, 0)) - F.min("low").over(w.rowsBetween(-4, 0))))
    return rounded(ft.features(B(s, d), ["mom10", "range5", "mom21"], catalogue=cat).select("symbol", "date", "mom10", "range5", "mom21"))


add("custom_features", "U5 F16", _custom,
    q.build("""SELECT symbol, date, round(close / lag(close, 10) OVER w - 1, 6) + 0e0 AS mom10, round(max(high) OVER (w ROWS 4 PRECEDING) - min(low) OVER (w ROWS 4 PRECEDING), 6) AS range5,
      round(close / lag(close, 21) OVER w - 1, 6) + 0e0 AS mom21 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""", "bars"))
add("trading_calendar", "J1", lambda s, d: pn.calendar(inp.all_bars(s, d)), q.build("SELECT * FROM cal", "cal"))
_P3 = ["mom63", "rv20_z", "normalized_slope"]
add("panel", "J2 F18", lambda s, d: rounded(inp.panel(s, d, _P3)),
    q.build(f"SELECT date, symbol, n, fresh, {r(*_P3)} FROM panel", "panel"))
add("ready_date", "F17", lambda s, d: pn.ready_date(inp.feats(s, d), 200, 0.8), q.build("SELECT d AS ready_date FROM ready", "ready"))
add("bars_received", "F17", lambda s, d: pn.bars_received(inp.feats(s, d)), q.build("SELECT symbol, max(n) AS bars FROM feats GROUP BY 1", "feats"))
add("snapshot", "F18", lambda s, d: rounded(pn.snapshot(inp.panel(s, d, _P3), "1999-06-15", _part_universe(s, d))),
    q.build(f"SELECT date, symbol, n, fresh, {r(*_P3)} FROM panel WHERE date = DATE '1999-06-15' AND symbol IN ({_UNI})", "panel"))
add("emit_every", "F19", lambda s, d: rounded(pn.emit_every(inp.panel(s, d, ["mom63"]), inp.cal(s, d), pn.ready_date(inp.feats(s, d)).first()[0], 21)),
    q.build(f"""SELECT date, symbol, n, fresh, {r('mom63')} FROM panel JOIN
      (SELECT date, row_number() OVER (ORDER BY date) AS k FROM cal WHERE date >= (SELECT d FROM ready)) USING (date) WHERE k % 21 = 0""", "panel", "cal", "ready"))
add("latest_snapshot", "F20", lambda s, d: rounded(pn.latest(inp.panel(s, d, _P3), inp.cal(s, d))),
    q.build(f"SELECT date, symbol, n, fresh, {r(*_P3)} FROM panel WHERE date = (SELECT max(date) FROM cal)", "panel", "cal"))
add("panel_get", "F21", lambda s, d: rounded(pn.get(inp.panel(s, d, ["rv20"]), "Brand#3", "rv20")),
    q.build("SELECT date, round(rv20, 6) AS value FROM panel WHERE symbol = 'Brand#3'", "panel"))
add("valid_ratio", "F22", lambda s, d: rounded(pn.valid_ratio(inp.feats(s, d), _P3)),
    q.build("""SELECT date, round(a, 6) AS mom63, round(b, 6) AS rv20_z, round(c, 6) AS normalized_slope, round((a + b + c) / 3, 6) AS all_features FROM (
      SELECT date, count(mom63) / count(*) AS a, count(rv20_z) / count(*) AS b, count(normalized_slope) / count(*) AS c FROM feats GROUP BY 1)""", "feats"))
add("features_long", "F23", lambda s, d: rounded(pn.to_long(inp.feats(s, d), _P3)),
    q.build("""SELECT date, symbol, 'mom63' AS feature, round(mom63, 6) + 0e0 AS value FROM feats UNION ALL
      SELECT date, symbol, 'rv20_z', round(rv20_z, 6) + 0e0 FROM feats UNION ALL
      SELECT date, symbol, 'normalized_slope', round(normalized_slope, 6) + 0e0 FROM feats""", "feats"))

# --- cross-section -----------------------------------------------------------------------------------------
add("xs_zscore", "D1", lambda s, d: rounded(xs.xs_zscore(inp.feats(s, d).select("symbol", "date", "mom63"), ["mom63"], ddof=1).drop("mom63")),
    q.build("""SELECT symbol, date, CASE WHEN mom63 IS NULL OR count(mom63) OVER d < 2 THEN NULL WHEN stddev_samp(mom63) OVER d < 1e-12 THEN 0e0
      ELSE round((mom63 - avg(mom63) OVER d) / stddev_samp(mom63) OVER d, 6) + 0e0 END AS mom63_z FROM feats WINDOW d AS (PARTITION BY date)""", "feats"))
add("xs_zscore_zero", "D4 D3",
    lambda s, d: rounded(xs.xs_zscore(inp.feats(s, d).select("symbol", "date", "dev20"), ["dev20"], on_too_few="zero").select(
        "symbol", "date", sc.winsorize("dev20_z", -2, 2).alias("z"))),
    q.build("""SELECT symbol, date, CASE WHEN dev20 IS NULL THEN NULL WHEN count(dev20) OVER d < 2 OR stddev_pop(dev20) OVER d < 1e-12 THEN 0e0
      ELSE round(greatest(-2e0, least(2e0, (dev20 - avg(dev20) OVER d) / stddev_pop(dev20) OVER d)), 6) + 0e0 END AS z FROM feats WINDOW d AS (PARTITION BY date)""", "feats"))
_RANK_SQL = q.build(f"SELECT symbol, date, round({q.unit_rank('mom21', 'date', '5e-1')}, 6) AS rank FROM feats", "feats")
_rank_in = lambda s, d: inp.feats(s, d).select("symbol", "date", "mom21")
add("xs_rank", "D2 W11", lambda s, d: rounded(xs.xs_rank(_rank_in(s, d), "mom21").drop("mom21")), _RANK_SQL)
add("xs_rank_in_parts", "D2 W11", lambda s, d: rounded(xs.xs_rank(_rank_in(s, d), "mom21", rows=0).drop("mom21")), _RANK_SQL)
_LOT = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem"
add("rank_with_ties", "D5 W11",
    lambda s, d: rounded(xs.xs_rank(demo.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity"),
                                    "l_quantity", "l_returnflag", single=0.0, rows=1000).drop("l_quantity")),
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, round({q.unit_rank('l_quantity', 'l_returnflag', '0e0')}, 6) AS rank FROM lineitem")

# --- market regime -----------------------------------------------------------------------------------------
_MF = ["log_return", "rv20_log", "vol_mean", "vol_sd", "z_vol", "max_dd", "normalized_slope", "ma_short", "ma_long"]
add("market_features", "E1 E2 E3 E4 E5 E6",
    lambda s, d: longs(rounded(mr.market_features(inp.market_bars(s, d)).select("date", *_MF, "ma_flag")), "ma_flag"),
    q.build(f"SELECT date, {r(*_MF)}, CAST(ma_flag AS BIGINT) AS ma_flag FROM mfeats", "mfeats"))


def _market(s: SparkSession, d: str, mode: str, rows: int = 65_536) -> DataFrame:
    m = mr.market_regime(inp.market_feats(s, d), mode=mode, rows=rows)
    x = F.col("scores")
    return rounded(m.select("date", "label", "confidence", x["raw_regime"].alias("raw_regime"), x["raw_confidence"].alias("raw_confidence"),
                            x["days_in_regime"].alias("days"), x["regime_start_date"].alias("since"), x["z_vol"].alias("z_vol")))


def _market_sql(state: str, idle: str, idle_conf: str) -> str:
    return q.build(f"""SELECT m.date, coalesce({q.M_LABEL.format(c='s.label')}, {idle}) AS label, round(coalesce(s.conf, {idle_conf}), 6) AS confidence,
      {q.M_NAME.format(c='s.raw_label')} AS raw_regime, round(s.raw_conf, 6) AS raw_confidence, CAST(s.days AS BIGINT) AS days, s.since,
      CASE WHEN s.date IS NOT NULL THEN round(m.z_vol, 6) + 0e0 END AS z_vol FROM mfeats m LEFT JOIN {state} s ON s.date = m.date""", "mfeats", state)


add("market_regime_live", "E7 E8 E9 E10 E11 E12 E14 E15", lambda s, d: _market(s, d, "live"), _market_sql("mstate_live", "'calm_range'", "0e0"))
add("market_regime_batch", "E7 E8 E9 E10 E11 E13 E15", lambda s, d: _market(s, d, "batch"), _market_sql("mstate_batch", "NULL", "NULL"))
add("market_regime_in_segments", "E10 E13", lambda s, d: _market(s, d, "batch", 150), _market_sql("mstate_batch", "NULL", "NULL"))


def _market_presets(s: SparkSession, d: str) -> DataFrame:
    f = inp.market_feats(s, d)
    out = None
    for name, cfg in (("conservative", MarketRegimeConfig.conservative()), ("sensitive", MarketRegimeConfig.sensitive())):
        m = mr.market_regime(f, cfg, mode="batch").select(F.lit(name).alias("preset"), "date", "label", "confidence")
        out = m if out is None else out.unionByName(m)
    return rounded(out)


add("market_regime_presets", "E7 E10", _market_presets,
    q.build(" UNION ALL ".join(f"""SELECT '{p}' AS preset, m.date, {q.M_LABEL.format(c='s.label')} AS label, round(s.conf, 6) + 0e0 AS confidence
      FROM mfeats m LEFT JOIN mstate_{p} s ON s.date = m.date""" for p in ("conservative", "sensitive")), "mfeats", "mstate_conservative", "mstate_sensitive"))

# --- stock regime ------------------------------------------------------------------------------------------
_SIG = ["normalized_slope", "daily_vol", "vol_z", "max_dd", "mom63", "ma_trend", "rv20"]
add("stock_signals", "G1", lambda s, d: rounded(sr.signals(inp.feats(s, d)).select("symbol", "date", *_SIG, "tradeable")),
    q.build(f"SELECT symbol, date, {r(*_SIG)}, tradeable FROM srule_sig", "srule_sig"))
add("stock_proposals", "G2 G3 G4", lambda s, d: rounded(inp.stock_rule(s, d)),
    q.build(f"SELECT symbol, date, label, {r('confidence')} FROM stock_rule", "stock_rule"))
_STOCK_SQL = q.build(f"SELECT symbol, date, label, {r('confidence')}, CAST(days AS BIGINT) AS days_in_regime, since AS regime_start FROM stock", "stock")
add("stock_regime", "G2 G3 G4 G5 G6 J3", lambda s, d: rounded(inp.stock_states(s, d).drop("reasons")), _STOCK_SQL)
add("stock_regime_in_segments", "G5 G6",
    lambda s, d: rounded(sr.stock_regime(inp.panel(s, d, sr.INPUTS), inp.market_states(s, d), rows=300).drop("reasons")), _STOCK_SQL)
add("regime_counts", "G7", lambda s, d: sr.regime_counts(inp.stock_rule(s, d)),
    q.build("""SELECT date, l AS label, count(*) FILTER (label = l) AS n FROM stock_rule,
      (SELECT unnest(['trending_up', 'trending_down', 'range_low_vol', 'stressed_high_vol', 'no_trade']) AS l) GROUP BY 1, 2""", "stock_rule"))

# --- alpha -------------------------------------------------------------------------------------------------


def _model_sql(m: str) -> str:
    return f"""SELECT date, symbol, '{m}' AS model, round(coalesce({m}_z, 0e0), 6) + 0e0 AS score, round(coalesce({m}_z, 0e0), 6) + 0e0 AS raw,
      round(CASE WHEN {m}_z IS NULL THEN 0e0 ELSE {m}_conf END, 6) AS confidence FROM models"""


for _m, _id in (("momentum", "H1"), ("meanrev", "H2"), ("lowvol", "H3")):
    add(f"alpha_{_m}", _id + " U1", lambda s, d, m=_m: rounded(al.BUILT_IN[m](inp.feats(s, d)).drop("reasons")), q.build(_model_sql(_m), "models"))
add("alpha_reasons", "H1 H2 H3 K4", lambda s, d: rounded(sk.explode_reasons(al.meanrev(inp.feats(s, d)).select("date", "symbol", "reasons"))),
    q.build("""SELECT date, symbol, reason, round(value, 6) + 0e0 AS value FROM (
      SELECT date, symbol, 'dev20' AS reason, coalesce(dev20, 0e0) AS value FROM models UNION ALL
      SELECT date, symbol, 'rv20_z', CASE WHEN dev20 IS NULL THEN 0e0 ELSE coalesce(rv20_z, 0e0) END FROM models UNION ALL
      SELECT date, symbol, 'z', coalesce(meanrev_z, 0e0) FROM models UNION ALL
      SELECT date, symbol, 'missing_data', 1e0 FROM models WHERE dev20 IS NULL)""", "models"))
add("run_models", "H4", lambda s, d: rounded(al.run_models(inp.feats(s, d))),
    q.build(" UNION ALL ".join(_model_sql(m) for m in ("lowvol", "meanrev", "momentum")), "models"))
add("ensemble_weights", "H5 J7",
    lambda s, d: rounded(al.weighted(al.run_models(inp.feats(s, d)), inp.market_rule(s, d)).select("date", "symbol", "model", "score", "ensemble_w")),
    q.build(" UNION ALL ".join(
        f"""SELECT date, symbol, '{m}' AS model, round(coalesce({m}_z, 0e0) * {q.weight_cases(m)[0]}, 6) + 0e0 AS score, {q.weight_cases(m)[0]} AS ensemble_w
            FROM (SELECT models.*, k.label AS market_label FROM models JOIN market_rule k USING (date))""" for m in ("lowvol", "meanrev", "momentum")),
        "models", "market_rule"))
_ROUTED = "SELECT date, symbol, {cols}, market_label, stock_label, gate FROM routed"
add("route_models", "H6 H7 H8 H9",
    lambda s, d: rounded(al.route(al.weighted(al.run_models(inp.feats(s, d)), inp.market_rule(s, d)), inp.market_rule(s, d), inp.stock_rule(s, d)).select(
        "date", "symbol", "score", "raw", "confidence", "market_label", "stock_label", "gate")),
    q.build(f"SELECT date, symbol, round(combined_score, 6) + 0e0 AS score, {r('raw', 'confidence')}, market_label, stock_label, gate FROM routed", "routed"))


def _ensemble(s: SparkSession, d: str, cfg: AlphaConfig = AlphaConfig(), parts: bool = False) -> DataFrame:
    return al.ensemble(inp.feats(s, d), inp.market_rule(s, d), inp.stock_rule(s, d), cfg, parts)


# Ranks compare the combined scores themselves, so rows whose scores differ only in the last bit are left to rows checks.
add("ensemble", "H11 H12 J3 J7",
    lambda s, d: rounded(_ensemble(s, d).select("date", "symbol", "combined_score", "raw", "confidence", "score", "gate")),
    q.build(f"SELECT date, symbol, {r('combined_score', 'raw', 'confidence', 'score')}, gate FROM alpha", "alpha"))
add("ensemble_gate_after_rank", "H11 H12",
    lambda s, d: rounded(_ensemble(s, d, AlphaConfig(gate_after_rank=True)).select("date", "symbol", "score")),
    q.build("SELECT date, symbol, round(CASE WHEN gate IS NOT NULL THEN 0e0 ELSE score END, 6) AS score FROM alpha", "alpha"))
add("alpha_attribution", "H10", lambda s, d: rounded(al.attribution(_ensemble(s, d, AlphaConfig(normalize_to_ranks=False), True))),
    q.build(" UNION ALL ".join(f"SELECT date, symbol, '{m}' AS model, round(contrib_{m}, 6) + 0e0 AS contrib, w_{m} AS weight FROM routed"
                               for m in ("lowvol", "meanrev", "momentum")), "routed"))
add("alpha_top", "H13 R2 R4",
    lambda s, d: rounded(longs(al.top_scores(_ensemble(s, d).select("date", "symbol", "score"), 5), "position")),
    q.build("""SELECT * FROM (SELECT date, symbol, round(score, 6) AS score, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS position FROM alpha)
      WHERE position <= 5""", "alpha"))
add("label_codes", "H14", lambda s, d: al.with_label_codes(al.with_regimes(inp.feats(s, d).select("date", "symbol"), inp.market_rule(s, d), inp.stock_rule(s, d))).drop("stock_conf"),
    q.build("""SELECT date, symbol, stock_label, market_label,
      CASE market_label WHEN 'calm_trend' THEN 0e0 WHEN 'calm_range' THEN 1e0 WHEN 'stress' THEN 2e0 WHEN 'crisis' THEN 3e0 ELSE -1e0 END AS market_code,
      CASE stock_label WHEN 'trending_up' THEN 0e0 WHEN 'trending_down' THEN 1e0 WHEN 'range_low_vol' THEN 2e0 WHEN 'stressed_high_vol' THEN 3e0
        WHEN 'no_trade' THEN 4e0 ELSE -1e0 END AS stock_code FROM routed_in""", "routed_in"))
