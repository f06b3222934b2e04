"""A bar history that is merged with new bars, kept as Parquet and CSV, and swapped as a whole.

A merge writes only the partitions that new bars touch, into a folder of its own version, first as Parquet and then, from those
files, as CSV. Last it publishes a manifest, a small JSON file that names for each partition the version that holds it.
Readers take the newest manifest, so until it stands they see the table as it was, and a merge that stopped anywhere
is simply run again. One writer at a time: a second one that publishes the same version raises.

Defined cases: new bars win on equal keys; of repeated new rows one stays; a null partition value is a partition of its own;
no new bars leave the table as it is, though a first merge without any makes an empty table; new bars may have further columns,
which are left out, and miss none. In the CSV files a missing value is empty and an empty text quoted; texts hold no line breaks.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.schema import require_columns
from barframe.sources.bars import dedupe_last
from barframe.sources.sinks import merge_bars

FORMATS = ("parquet", "csv")
CSV = {"header": "true", "charToEscapeQuoteEscaping": "\\", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
EMPTY = "\x01"  # what the reader gives for a quoted empty text, which it would else take for a missing value


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/manifest") if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    fs, place = _place(spark, f"{path}/manifest/{version:012d}.json")
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """Write the manifest beside its place and move it there in one step."""
    fs, made = _place(spark, f"{path}/manifest/{version:012d}.part")
    stream = fs.create(made, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    place = _place(spark, f"{path}/manifest/{version:012d}.json")[1]
    if fs.exists(place) or not fs.rename(made, place):
        raise RuntimeError(f"version {version} of {path} was published by another writer")


def _write(df: DataFrame, folder: str, fmt: str, partition: str) -> None:
    writer = df.write.mode("overwrite").partitionBy(partition)
    if fmt == "csv":
        writer.options(**CSV).csv(folder)
    else:
        writer.parquet(folder)


def _read(spark: SparkSession, path: str, manifest: dict, fmt: str) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    folders = [f"{path}/{fmt}/version={v}/{p}" for p, v in manifest["partitions"].items()]
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{path}/{fmt}")
    if fmt == "csv":
        df = reader.options(**CSV, emptyValue=EMPTY, mode="FAILFAST", enforceSchema="false").csv(folders)
        texts = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType) and f.name != manifest["partition"]}
        return df.select(*[F.when(F.col(c) == EMPTY, "").otherwise(F.col(c)).alias(c) if c in texts else c for c in schema.fieldNames()])
    return reader.parquet(*folders).select(*schema.fieldNames())


def read_history(spark: SparkSession, path: str, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """The table of the newest version, or of an older one that is still kept. Only the live partitions' folders are listed."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no version {'' if version is None else version} of a bar history in {path}")
    return _read(spark, path, _manifest(spark, path, known[-1] if version is None else version), fmt)


def upsert_history(spark: SparkSession, path: str, new: DataFrame, partition: str, keys: tuple[str, ...] = ("symbol", "date")) -> int:
    """Merge ``new`` into the history at ``path`` (made if there is none) and return the version published.

    Bars of one key must lie in one partition. One Spark job reads the touched old partitions and the new bars and shuffles them
    by key; the CSV files are written from its Parquet files.
    """
    known = versions(spark, path)
    version = known[-1] + 1 if known else 1
    if known:
        manifest = _manifest(spark, path, known[-1])
        if manifest["partition"] != partition:
            raise ValueError(f"the history is partitioned by {manifest['partition']}, not {partition}")
        fields = T.StructType.fromJson(manifest["schema"]).fields
        require_columns(new, [f.name for f in fields])
        new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        touched = new.select(F.col(partition).alias("_touched")).distinct()
        old = _read(spark, path, manifest, "parquet")
        merged = merge_bars(old.join(touched, F.col(partition).eqNullSafe(F.col("_touched")), "left_semi"), new, keys)
    else:
        require_columns(new, [*keys, partition])
        order = [c for c in new.columns if c not in (*keys, partition)] + [partition]
        new = new.select(*keys, *order)
        merged = dedupe_last(new, keys, order)
        manifest = {"partition": partition, "schema": json.loads(T.StructType([T.StructField(f.name, f.dataType) for f in new.schema.fields]).json()), "partitions": {}}
    # Few, full files: adaptive execution merges small partitions and splits large ones.
    _write(merged.hint("rebalance", partition), f"{path}/parquet/version={version}", "parquet", partition)
    found = {n: version for n in _names(spark, f"{path}/parquet/version={version}") if n.startswith(f"{partition}=")}
    if known and not found:
        return known[-1]
    manifest = {**manifest, "partitions": {**manifest["partitions"], **found}}
    if found:
        part = _read(spark, path, {**manifest, "partitions": found}, "parquet")
        _write(part, f"{path}/csv/version={version}", "csv", partition)
    _publish(spark, path, version, manifest)
    return version


def forget_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete manifests but the newest ``keep``, then the partition folders that no kept one names (of stopped merges too)."""
    if keep < 1:
        raise ValueError(f"keep must be at least 1, got {keep}")
    known = versions(spark, path)
    live = {(v, p) for k in known[-keep:] for p, v in _manifest(spark, path, k)["partitions"].items()}
    for k in known[:-keep]:
        fs, place = _place(spark, f"{path}/manifest/{k:012d}.json")
        fs.delete(place, False)
    for fmt in FORMATS:
        for folder in _names(spark, f"{path}/{fmt}"):
            for part in _names(spark, f"{path}/{fmt}/{folder}"):
                if "=" in part and (int(folder.partition("=")[2]), part) not in live:
                    fs, place = _place(spark, f"{path}/{fmt}/{folder}/{part}")
                    fs.delete(place, True)
