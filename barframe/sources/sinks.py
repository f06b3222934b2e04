"""Writing bars and results, and merging new bars into history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.sources.bars import dedupe_last


def write_bars(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None
) -> None:
    """Write Parquet or CSV; folders are created. Cluster by the partition columns first: few, full files."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt}")
    if partition_by:
        df = df.repartition(*partition_by, F.xxhash64("symbol", "date") % 8)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.parquet(path)


def merge_bars(history: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """History plus new bars; the new bar wins on an equal key."""
    both = history.withColumn("_prio", F.lit(0)).unionByName(new.withColumn("_prio", F.lit(1)))
    return dedupe_last(both, keys, ["_prio"]).drop("_prio")


def to_json_column(df: DataFrame, columns: list[str], out: str = "json") -> DataFrame:
    """One JSON object per row from ``columns``; the inverse is :func:`from_json_column`."""
    return df.withColumn(out, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def from_json_column(df: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    return df.select(F.from_json(column, schema).alias("_j")).select("_j.*")


def explode_reasons(df: DataFrame, column: str = "reasons") -> DataFrame:
    """One row per reason key and value."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.explode(column).alias("reason", "value"))
