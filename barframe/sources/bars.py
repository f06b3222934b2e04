"""Bar tables: per-symbol files, one long table, vendor columns, date range, candle look-up."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.functions.scalar import clean
from barframe.schema import BARS, require_columns

# Vendor short names and the standard names they stand for.
VENDOR = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
VENDOR_ONLY = ("o", "h", "l", "c", "v", "vw", "t", "n")


TIMES = ("timestamp", "date", "t")
HEADER_THREADS = 32  # CSV files whose first line is read at a time


def to_time(column: str, kind: T.DataType) -> Column:
    """A time column as a timestamp. Whole numbers are epoch seconds, milli-, micro- or nanoseconds, told by their size."""
    c = F.col(column)
    if not isinstance(kind, T.IntegralType):
        return c.cast("timestamp")
    size, n = F.abs(c), c.cast("long")
    micros = (
        F.when(size >= 10**17, F.expr(f"`{column}` div 1000"))
        .when(size >= 10**14, n)
        .when(size >= 10**11, n * 1000)
        .otherwise(n * 1_000_000)
    )
    return F.timestamp_micros(micros)


def standardize(df: DataFrame) -> DataFrame:
    """Add ``timestamp`` and open/high/low/close/volume, each from the standard or else the vendor column, row by row.

    Files of both kinds may be mixed. Columns of neither name raise. ``t`` is epoch milliseconds.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    times = [F.timestamp_millis(F.col("t").cast("long")) if c == "t" else to_time(c, kinds[c]) for c in TIMES if c in kinds]
    if not times:
        raise ValueError("missing columns: ['timestamp' or 't']")
    cols: dict[str, Column] = {"timestamp": F.coalesce(*times)}
    for short, name in VENDOR.items():
        found = [F.col(c) for c in (name, short) if c in kinds]
        if not found:
            raise ValueError(f"missing columns: ['{short}' or '{name}']")
        cols[name] = F.coalesce(*found) if len(found) > 1 else found[0]
    return df.withColumns(cols)


def drop_vendor(df: DataFrame) -> DataFrame:
    return df.drop(*VENDOR_ONLY)


def normalize_date(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Replace the bar time by its UTC date (session time zone UTC)."""
    return df.withColumn("date", F.to_date(F.col(ts)))


def dedupe_last(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    An aggregate, not a window: copies of one key collapse before the shuffle, however many there are.
    """
    keys, order = list(keys), list(order)
    row = F.struct(*[c for c in df.columns if c not in keys])
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(F.max_by(row, rank).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def between_dates(df: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """Inclusive range filter; a plain predicate, so Parquet prunes row groups with it."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(str(start)).cast(df.schema[column].dataType))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(str(end)).cast(df.schema[column].dataType))
    return df


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Keep the rows whose symbol is in ``universe``."""
    return df.join(universe.select("symbol").distinct(), "symbol", "left_semi")


def missing_symbols(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Universe symbols without a bar."""
    return universe.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")


def load_universe(bars: DataFrame, universe: DataFrame, strict: bool = False) -> DataFrame:
    """Bars of the universe's symbols; with ``strict`` a symbol without bars raises ``ValueError``."""
    if strict:
        gone = missing_symbols(bars, universe).limit(10).collect()
        if gone:
            raise ValueError(f"no bars for symbols: {sorted(r['symbol'] for r in gone)}")
    return in_universe(bars, universe)


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of ``first`` plus the rows of ``second`` for symbols ``first`` does not hold."""
    only_second = second.join(first.select("symbol").distinct(), "symbol", "left_anti")
    return first.unionByName(only_second)


def _shape(df: DataFrame, order: list[str]) -> DataFrame:
    """Bring one read to the bar schema: vendor names, UTC date, doubles with NaN as NULL.

    Of rows with one symbol and date the last time stays, and of equal times the last row of the last file.
    """
    df = normalize_date(standardize(df))
    df = dedupe_last(df, ["symbol", "date"], ["timestamp", *order])
    values = [clean(c).alias(c) for c in ("open", "high", "low", "close", "volume")]
    return df.select("symbol", "date", *values)


def _files(spark: SparkSession, timeframe: str, fmt: str):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*_{timeframe}.{fmt}")


def _symbol(timeframe: str, fmt: str) -> Column:
    """The symbol in a file's name; Spark gives paths with escapes."""
    name = F.regexp_extract(F.col("_file"), rf"([^/]+)_{timeframe}\.{fmt}", 1)
    return F.url_decode(F.regexp_replace(name, r"\+", "%2B"))


def _read_parquet(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    reader = _files(spark, timeframe, "parquet").option("mergeSchema", "true")
    try:
        df = reader.parquet(path)
    except Exception as error:
        if "NANOS" not in str(error):
            raise
        # Nanosecond times, as pandas writes them, can be read as whole numbers only, and Spark has no option for one read.
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        df = reader.parquet(path)
    df = df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    return _shape(df.withColumn("symbol", _symbol(timeframe, "parquet")), ["_file", "_row"])


def _headers(spark: SparkSession, files: list[str]) -> dict[str, tuple[str, ...]]:
    """Column names by file, from its first line that is not blank; files without one are left out.

    Only the start of a file is read, many files at a time, and no job is run.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def head(file: str) -> tuple[str, ...]:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = place.getFileSystem(conf).open(place)
        try:
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
            while (line := lines.readLine()) is not None:
                if line.strip("\ufeff \t"):
                    return tuple(c.strip().lower() for c in next(csv.reader([line.lstrip("\ufeff")])))
        finally:
            stream.close()
        return ()

    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        return {f: h for f, h in zip(files, pool.map(head, files), strict=True) if h}


def _glob_safe(spark: SparkSession, file: str) -> str:
    """A file's path for a reader that would take ``{}[]*?`` in it for a pattern."""
    plain = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).toString()
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", plain)


def _csv_rows(reader, paths: list[str] | str, head: tuple[str, ...]) -> DataFrame:
    """Rows of files with one header, their known columns by name; of equal names the first counts."""
    names = {n: f"_c{head.index(n)}" for n in (*TIMES, *VENDOR.values(), *VENDOR) if n in head}
    schema = ", ".join(f"_c{i} string" for i in range(len(head)))
    raw = reader.schema(schema).option("header", "true").csv(paths)
    cells = {n: F.lower(F.trim(c)) for n, c in names.items()}
    raw = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), *[c.alias(n) for n, c in cells.items()])
    raw = raw.withColumn("_row", F.monotonically_increasing_id())
    again = F.lit(True)  # a header that stands again between the rows
    for n in names:
        again = again & F.col(n).eqNullSafe(F.lit(n))
    whole_number = lambda c: F.when(c.rlike("^-?[0-9]+$"), c.cast("long"))
    values = {n: F.col(n) if n in ("timestamp", "date") else whole_number(F.col(n)) if n == "t" else F.col(n).try_cast("double") for n in names}
    df = raw.filter(~again).select("_file", "_block", "_row", *[v.alias(n) for n, v in values.items()])
    # Times are texts here: numbers are epochs, others are dates or times.
    for n in ("timestamp", "date"):
        if n in names:
            df = df.withColumn("_n", whole_number(F.col(n)))
            df = df.withColumn(n, F.coalesce(to_time("_n", T.LongType()), F.try_to_timestamp(F.upper(n)))).drop("_n")
    return df


def _read_csv(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """CSV files by the names of their own headers, so files may differ in columns, their number and their order.

    Files are grouped by header, and each group is one scan of the columns it needs. Files without a line hold no bars.
    """
    files = _files(spark, timeframe, "csv").schema("_c0 string").csv(path).inputFiles()
    heads = _headers(spark, files)
    bad = [f for f, h in heads.items() if not set(TIMES) & set(h) or any(not {short, name} & set(h) for short, name in VENDOR.items())]
    if bad:
        raise ValueError(f"bar files without all columns in their header: {sorted(bad)[:5]}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for f, h in heads.items():
        groups.setdefault(h, []).append(f)
    if len(groups) <= 1:  # files without a line give no rows
        head = next(iter(groups), ("date", *VENDOR.values()))
        df = _csv_rows(_files(spark, timeframe, "csv"), path, head)
    else:
        parts = [_csv_rows(spark.read, [_glob_safe(spark, f) for f in own], h) for h, own in groups.items()]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _shape(df.withColumn("symbol", _symbol(timeframe, "csv")), ["_file", "_block", "_row"])


def has_files(spark: SparkSession, path: str, timeframe: str, fmt: str) -> bool:
    """Whether the folder holds bar files of a kind, at any depth."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return False
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*_{timeframe}.{fmt}")
    return bool(found.load(path).inputFiles())


def read_bars(
    spark: SparkSession,
    path: str,
    symbols: list[str] | None = None,
    start=None,
    end=None,
    strict: bool = False,
    timeframe: str = "1d",
) -> DataFrame:
    """Bars from per-symbol files ``{SYMBOL}_{timeframe}.parquet`` or ``.csv``; Parquet wins per symbol."""
    readers = {"parquet": _read_parquet, "csv": _read_csv}
    parts = [read(spark, path, timeframe) for fmt, read in readers.items() if has_files(spark, path, timeframe, fmt)]
    if not parts:
        raise FileNotFoundError(f"no *_{timeframe} bar files in {path}")
    bars = parts[0] if len(parts) == 1 else prefer(parts[0], parts[1])
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(list(symbols)))
        if strict:
            found = {r["symbol"] for r in bars.select("symbol").distinct().limit(len(symbols)).collect()}
            gone = sorted(set(symbols) - found)
            if gone:
                raise ValueError(f"no bars for symbols: {gone}")
    return between_dates(bars, start, end)


def read_bar_table(spark: SparkSession, path: str, start=None, end=None, symbols: list[str] | None = None) -> DataFrame:
    """Bars from one Parquet table with the standard schema (symbol may be a partition column)."""
    df = spark.read.parquet(path)
    require_columns(df, ["symbol", "date", "close", "volume"])
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    return between_dates(df, start, end).select(*[c for c in BARS.fieldNames() if c in df.columns])


def candles(bars: DataFrame, symbol: str, start=None, end=None, limit: int = 200) -> DataFrame:
    """The last ``limit`` bars of one symbol inside [start, end], oldest first."""
    if not 1 <= limit <= 5000:
        raise ValueError(f"limit must be in [1, 5000], got {limit}")
    hit = between_dates(bars.filter(F.col("symbol") == symbol.upper()), start, end)
    return hit.orderBy(F.desc("date")).limit(limit).orderBy("date")


def last_date(df: DataFrame, column: str = "date") -> DataFrame:
    return df.agg(F.max(column).alias("last_date"))
