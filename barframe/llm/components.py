"""Connected components over links: blocks of links contracted by numpy, then alternating star contractions across blocks.

A block is at most ``BLOCK`` links, whatever their number: each is replaced by links to the least node of its own components.
If one block holds all, that is the result. Otherwise blocks are joined by star steps, which aggregate minima only and never
list neighbours, until these change nothing or one block is enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.plans.settle import release, settle

BLOCK = 1 << 15


def _sum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of some links, and the least node of the component of each among these links."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        u, v = root[left], root[right]
        if np.array_equal(u, v):
            return ids, ids[root]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, up := root[root]):
            root = up


def _contracted(pairs: DataFrame, links: int, block: int) -> DataFrame:
    """(a, b): each node of a block of links (a, b) with the least of its component there; the least ones with themselves."""

    def blocks(batches):
        held, rows = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                if rows + part.num_rows > block:
                    yield done(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield done(held)

    def done(held):
        a, b = contract(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.coalesce(-(-links // block)).mapInArrow(blocks, "a long, b long")


def components(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) of every node of links (a, b), as a written table: root is the smallest node of its component.

    ``links`` has two long columns without nulls, in any order and with any repeats; links of a node with itself are ignored.
    """
    pairs = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    while True:
        count = pairs.count()
        if not count:
            return pairs.toDF("node", "root")
        near = _contracted(pairs, count, block)
        if count <= block:
            near = settle(near, "links")
            release(pairs, sweep=False)
            return near.toDF("node", "root")
        near = settle(near.filter("a <> b").distinct(), "links")
        both = near.union(near.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a")
        small = down.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        star = settle(small.distinct(), "links")
        release(pairs, sweep=False)
        same = _sum(near) == _sum(star)
        release(near, sweep=False)
        if same:
            out = settle(star.union(star.select("b", "b")).toDF("node", "root").distinct(), "links")
            release(star, sweep=False)
            return out
        pairs = star
