"""The state store that keyed operators on streams need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def require_rocksdb(spark: SparkSession) -> None:
    """Raise unless the session keeps streaming state in RocksDB; Spark reads the setting when a query starts."""
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB} before the stream starts")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The session keeps streaming state in RocksDB inside the block; afterwards its setting is what it was."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
