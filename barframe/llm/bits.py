"""Bit tables of 64-bit keys: a broadcast filter of bounded size in front of an exact join or count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_EACH = 32
MAX_BITS = 1 << 28


class Known:
    """``has`` may be true for other keys too, never false for one of the table's."""

    def __init__(self, bits: int, segments: dict[int, bytes]):
        self.bits = bits
        self.table = np.zeros(bits // 8, dtype=np.uint8)
        for k, part in segments.items():
            own = np.frombuffer(part, np.uint8)[: bits // 8]
            self.table[(k - 1) * 4096 : (k - 1) * 4096 + len(own)] = own

    def has(self, h: np.ndarray) -> np.ndarray:
        x = (h & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.table[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


def known(keys: DataFrame, key: str = "fp", bits_each: int = BITS_EACH, max_bits: int = MAX_BITS) -> Known:
    """The bit table of a column of longs that are hashes: ``bits_each`` bits a key, ``max_bits`` (32 MB) at most on the driver.

    A full table filters less; it never loses a key.
    """
    wanted = max(keys.count() * bits_each, 1 << 15)
    bits = min(1 << (wanted - 1).bit_length(), max_bits)
    x = F.col(key).bitwiseAND(F.lit(bits - 1)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("part"))
    return Known(bits, {r.k: bytes(r.part) for r in parts.collect()})


def may_be_in(table: Known, key: Column, spark) -> Column:
    """False only for keys (longs) that are not in the table; false for null. Only the key column goes to Python."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(h.to_numpy(dtype=np.int64).view(np.uint64)))

    return F.when(key.isNull(), F.lit(False)).otherwise(test(F.coalesce(key, F.lit(0).cast("long"))))
