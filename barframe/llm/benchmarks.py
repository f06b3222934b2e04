"""Benchmark decontamination: windows of test items found in training texts by a broadcast hash set.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Every run of ``n`` consecutive words of an item is
a window; an item with fewer words, but not none, is one window. Rolling window hashes of each text are looked up in
the sorted hashes of the items (a bit table in front drops most), and each hit is verified word by word.

The items are broadcast in blocks of at most ``block_bytes`` of text. A larger benchmark is searched block after block,
each block against all rows, and the spans found so far travel with the rows.

Defined cases: a null or empty text has no words and no hits; items with a null id or without words are left out; one id
with several texts counts once; repeated documents are scanned one by one; an empty table on either side gives no hit.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm import words as wd
from barframe.plans.settle import settle

N_WORDS = 10
BLOCK_BYTES = 4 << 20
_BITS = 20
_HITS = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def windows(items: list[tuple[str, str]], n: int) -> tuple:
    """Of a block of items: ids, their words, and by window length the sorted hashes with item, first word and bit table."""
    ids, texts, found = [], [], {}
    column = pa.array([t for _, t in items], pa.string())
    data, offsets = wd.buffers(column)
    w = wd.words(data, offsets, plain=True, lower=True)
    for i, (item, _) in enumerate(items):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if a == b:
            continue
        k = min(n, b - a)
        h = w.hash[a:b]
        hashes = wd.gram_hash([h[j : len(h) - k + 1 + j] for j in range(k)])
        found.setdefault(k, []).append((hashes, np.full(len(hashes), len(ids)), np.arange(len(hashes))))
        ids.append(item)
        texts.append([w.text(j) for j in range(a, b)])
    by_length = {}
    for k, parts in found.items():
        hashes, item, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        table = np.zeros(1 << _BITS, dtype=bool)
        table[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        by_length[k] = hashes, item[order], start[order], table
    return ids, texts, by_length


def find(w: wd.Words, known: tuple) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """By row: word ranges of verified windows, and the items they come from."""
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    names, texts, by_length = known
    for k, (hashes, item, start, table) in by_length.items():
        grams, at = w.grams(k)
        maybe = np.flatnonzero(table[(grams & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        if not len(maybe):
            continue
        g, at = grams[maybe], at[maybe]
        lo, hi = np.searchsorted(hashes, g, "left"), np.searchsorted(hashes, g, "right")
        for j in np.flatnonzero(hi > lo):
            p = int(at[j])
            own = [w.text(p + x) for x in range(k)]
            row = int(np.searchsorted(w.first, p, "right")) - 1
            for c in range(int(lo[j]), int(hi[j])):
                s = int(start[c])
                if texts[item[c]][s : s + k] == own:
                    spans, ids = out.setdefault(row, ([], set()))
                    q = p - int(w.first[row])
                    if not spans or spans[-1] != (q, q + k):
                        spans.append((q, q + k))
                    ids.add(names[item[c]])
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, item: str, text: str, n: int, block_bytes: int):
    """Broadcast windows, block by block; each holds about ``block_bytes`` of text."""
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.col(text).alias("text")).dropna().distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    for b in range(count):
        rows = sorted((r.id, r.text) for r in items.filter(part == b).collect())
        yield benchmark.sparkSession.sparkContext.broadcast(windows(rows, n))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id",
                   item_text: str = "text", n: int = N_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``id``, n_words, spans (word ranges, merged), items (ids found, sorted)."""
    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"),
                       F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"),
                       F.expr("cast(array() as array<string>)").alias("items"))
    known = list(blocks(benchmark, item, item_text, n, block_bytes))
    for b, block in enumerate(known):
        last = b == len(known) - 1

        def scan(batches, block=block, first=b == 0, last=last):
            for batch in batches:
                counts, spans, items = [], [], []
                old = None if first else (batch.column("spans").to_pylist(), batch.column("items").to_pylist())
                for lo, hi, w in wd.batch_words(batch.column("text"), plain=True, lower=True):
                    hits = find(w, block.value)
                    counts.append(w.counts())
                    for r in range(hi - lo):
                        s, ids = hits.get(r, ((), ()))
                        if old:
                            s = [*s, *((x["start"], x["end"]) for x in old[0][lo + r])]
                            ids = {*ids, *old[1][lo + r]}
                        spans.append([{"start": a, "end": z} for a, z in merged(s)] if s else [])
                        items.append(sorted(ids))
                texts = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), texts, pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                     pa.array(spans, pa.list_(_HITS)), pa.array(items, pa.list_(pa.string()))],
                    names=["id", "text", "n_words", "spans", "items"])

        rows = rows.mapInArrow(wd.lean(scan), schema)
        if not last:
            rows = settle(rows, "benchmark_block")
    return rows.select(F.col("id").alias(id), "n_words", "spans", "items")


def hit_words(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def without_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
                      n: int = N_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit, all columns kept."""
    out = docs
    for block in blocks(benchmark, item, item_text, n, block_bytes):

        def clean(batches, block=block):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, _, w in wd.batch_words(batch.column(batch.schema.get_field_index(text)), plain=True, lower=True):
                    keep[[lo + r for r in find(w, block.value)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(wd.lean(clean), docs.schema)
    return out
