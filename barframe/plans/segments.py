"""Per-key ordered work that stays parallel inside one key.

A rolling window over ``partitionBy(symbol)`` puts a symbol in one task. That is right while symbols are
short and wrong when one symbol holds a large share of the rows. ``segment`` measures the longest key
first. Short keys use the plain window, one shuffle. Long keys are numbered with prefix counts and cut
into row segments; every segment carries copies of the rows its frames look back (or ahead) to, so the
results are the same to the last row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.plans.settle import settle

SEGMENT_ROWS = 65_536


def as_list(by: str | list[str] | tuple[str, ...]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def time_bucket(df: DataFrame, order: str) -> Column:
    """Coarse time bucket of the order column: the year of a date, the day of a timestamp."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return F.year(order)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(order)
    return F.floor(F.col(order) / F.lit(SEGMENT_ROWS))


def running_sum(
    df: DataFrame,
    by: str | list[str],
    order: str | list[str],
    value: Column,
    out: str,
    rows: int = SEGMENT_ROWS * 16,
    largest: int | None = None,
) -> DataFrame:
    """Cumulative ``sum(value)`` per key: totals of earlier buckets (pre-aggregated) plus a sum inside the bucket.

    Buckets are years or days while the fullest one is measured to hold at most ``rows`` rows. Otherwise the
    rows are range-partitioned by (key, order) into parts of about ``rows`` rows and settled, so a part's number is
    plain data that every later stage and every retry agrees on. Doubles are added as decimals of ten places, so
    the sums are the same however the rows are cut. ``order`` must be unique inside a key.
    """
    by, order = as_list(by), as_list(order)
    d = df.withColumn("_rs_b", time_bucket(df, order[0]))
    if largest is None:
        largest = longest_key(d, [*by, "_rs_b"])
    if largest > rows:
        parts = -(-df.count() // max(rows, 1))
        ranged = df.repartitionByRange(parts, *by, *order)
        d = settle(ranged.withColumn("_rs_b", F.spark_partition_id()), "ranged")
    d = d.withColumn("_rs_v", value)
    exact = d.schema["_rs_v"].dataType.typeName() in ("double", "float")
    if exact:
        d = d.withColumn("_rs_v", F.col("_rs_v").cast("decimal(28,10)"))
    totals = d.groupBy(*by, "_rs_b").agg(F.sum("_rs_v").alias("_rs_t"))
    before = Window.partitionBy(*by).orderBy("_rs_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_rs_b", F.coalesce(F.sum("_rs_t").over(before), F.lit(0)).alias("_rs_o"))
    inside = Window.partitionBy(*by, "_rs_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_rs_o") + F.sum("_rs_v").over(inside)
    return (
        d.join(offsets, [*by, "_rs_b"])
        .withColumn(out, total.cast("double") if exact else total)
        .drop("_rs_b", "_rs_v", "_rs_o")
    )


def numbered(df: DataFrame, by: str | list[str], order: str, out: str = "n", flag: Column | None = None) -> DataFrame:
    """1-based position per key, counting only the rows where ``flag`` holds when it is given.

    Rows are unique per (key, order), so a year of dates is small and needs no measuring.
    """
    one = F.lit(1).cast("long") if flag is None else F.when(flag, 1).otherwise(0).cast("long")
    bounded = 366 if isinstance(df.schema[order].dataType, T.DateType) else None
    return running_sum(df, by, order, one, out, largest=bounded)


def longest_key(df: DataFrame, by: str | list[str]) -> int:
    """Rows of the largest key; one map-side-combined count, one number back to the driver."""
    row = df.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()
    return int(row[0] or 0)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash by ``keys`` into the session's number of shuffle partitions.

    Windows and folds are heavy on CPU and their rows are narrow, so tasks are not merged by byte size the
    way adaptive execution would. The windows that follow reuse this partitioning.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


@dataclass(frozen=True)
class Segments:
    """Rows with their position ``n``; ``keys`` partition the windows, ``halo`` marks copied rows."""

    df: DataFrame
    keys: list[str]
    split: bool

    def window(self, order: str):
        return Window.partitionBy(*self.keys).orderBy(order)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop the copied rows once the windows are computed; the segment columns stay for folds."""
        return df.filter(~F.col("_halo")).drop("_halo") if self.split else df


def segment(
    df: DataFrame,
    by: str | list[str] = "symbol",
    order: str = "date",
    before: int = 0,
    after: int = 0,
    rows: int = SEGMENT_ROWS,
    longest: int | None = None,
) -> Segments:
    """Plan windows over ``by``: whole keys when the longest fits ``rows``, else segments with copies.

    ``before`` and ``after`` are the rows the frames reach back and ahead. Rows must be unique in
    ``(by, order)``. Pass ``longest`` when it is known to save the count.
    """
    by = as_list(by)
    if longest is None:
        longest = longest_key(df, by)
    if longest <= rows:
        w = Window.partitionBy(*by).orderBy(order)
        return Segments(spread(df, by).withColumn("n", F.row_number().over(w).cast("long")), by, False)
    rows = max(rows, before, after, 1)
    d = numbered(df, by, order)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    own = F.expr(f"(n - 1) div {rows}")
    at = F.expr(f"(n - 1) % {rows}")
    last = F.expr(f"(_size - 1) div {rows}")
    d = d.join(sizes, by).withColumn("_own", own).withColumn("_last", last)
    targets = F.array_compact(
        F.array(
            F.col("_own"),
            F.when((at >= rows - before) & (F.col("_own") < F.col("_last")), F.col("_own") + 1),
            F.when((at < after) & (F.col("_own") > 0), F.col("_own") - 1),
        )
    )
    d = (
        d.withColumn("_seg", F.explode(targets))
        .withColumn("_halo", F.col("_seg") != F.col("_own"))
        .withColumn("_more", F.col("_seg") < F.col("_last"))
        .drop("_own", "_last", "_size")
    )
    keys = [*by, "_seg", "_more"]
    return Segments(spread(d, keys), keys, True)
