"""Line dedup by winnowing: passages of at least ``MIN_WORDS`` words in whole lines that occurred before are deleted.

Lines with a word are hashed. From each line on, the shortest run of lines with ``MIN_WORDS`` words is a window, and the least
line hash in a window is its fingerprint, so two texts that share a run of that many words surely share a fingerprint.
Fingerprints are joined to their first place in (id, text hash, line) order; the hash of the window stands with them in the
join, so a frequent line does not lead to places that have nothing else in common. Only the first place is joined, so the
pairs grow with the fingerprints, never with the square of a group. Matches on one diagonal of two texts are extended
both ways as long as lines are equal, and the later run is deleted: every deleted line has an earlier equal line that stays.

Lines are told apart byte by byte; lines without a word separate nothing, are never deleted and stay where they are.

Defined cases: a null text stays null, with no lines; an empty text stays empty; a text with fewer words has no window; a null
id comes first; rows that repeat id and text are one document, so both get the same result; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.plans.settle import settle

MIN_WORDS = 50


def hashed_lines(text: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of the lines with a word: place among all lines, hash and number of words."""
    import xxhash

    at, hashes, words = [], [], []
    for i, line in enumerate(text.split(b"\n")):
        if n := len(line.split()):
            at.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(line))
            words.append(n)
    return at, np.array(hashes, dtype=np.uint64).view(np.int64), np.array(words, dtype=np.int64)


def windows(hashes: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(fingerprint, hash of the window, first line) of each window."""
    import xxhash

    upto = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(upto, upto[:-1] + min_words, "left")
    raw = hashes.tobytes()
    return [(int(hashes[i:e].min()), xxhash.xxh3_64_intdigest(raw[8 * i : 8 * e]) - (1 << 63), i) for i, e in enumerate(ends) if e < len(upto)]


def same_run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """The run of lines of ``a`` around i that equals the run of ``b`` around j."""
    lo = hi = 0
    while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
        hi += 1
    return i - lo, i + hi


def repeated_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text_hash, runs): for documents with repeats, ranges of their lines with a word to delete."""
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))

    def hashes(batches):
        shape = pa.struct([("h", pa.int64()), ("c", pa.int64()), ("i", pa.int32())])
        for batch in batches:
            lines, found = [], []
            for t in batch.column("text").cast(pa.large_binary()):
                _, h, n = hashed_lines(t.as_py() or b"")
                lines.append(h)
                found.append([{"h": a, "c": b, "i": i} for a, b, i in windows(h, n, min_words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(lines, pa.list_(pa.int64())), pa.array(found, pa.list_(shape))],
                names=["id", "text_hash", "lines", "windows"])

    hashed = settle(rows.mapInArrow(hashes, f"id {kind}, text_hash long, lines array<long>, windows array<struct<h:long,c:long,i:int>>"), "lines")
    each = hashed.select("id", "text_hash", F.explode("windows").alias("w")).select(F.col("w.h").alias("h"), F.col("w.c").alias("c"), F.struct("id", "text_hash", F.col("w.i").alias("i")).alias("place"))
    firsts = each.groupBy("h", "c").agg(F.min("place").alias("first"), F.count("*").alias("uses")).filter("uses > 1").drop("uses")
    later = each.join(firsts, ["h", "c"]).filter(F.col("place") > F.col("first"))
    # One start for each diagonal and stretch: matches on a diagonal whose windows touch extend to the same run.
    diagonal = F.col("place.i") - F.col("first.i")
    pairs = later.select(F.col("place.id").alias("id"), F.col("place.text_hash").alias("text_hash"), F.col("first.id").alias("id0"), F.col("first.text_hash").alias("text_hash0"),
                         diagonal.alias("diagonal"), F.col("place.i").alias("i"))
    pairs = settle(pairs.groupBy("id", "text_hash", "id0", "text_hash0", "diagonal").agg(F.sort_array(F.collect_set("i")).alias("starts")), "matches")

    # Keys for the joins with line hashes; rows that repeat a document have the same lines.
    key = lambda a, b: F.xxhash64(F.col(a).cast("string"), F.col(b), F.col(a).isNull())
    held = hashed.select(key("id", "text_hash").alias("key"), "lines")
    wanted = pairs.select(key("id", "text_hash").alias("key")).union(pairs.select(key("id0", "text_hash0"))).distinct()
    held = settle(held.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("lines").alias("lines")), "held")
    full = pairs.withColumn("key", key("id", "text_hash")).withColumn("key0", key("id0", "text_hash0"))
    full = full.join(held, "key").join(held.select(F.col("key").alias("key0"), F.col("lines").alias("lines0")), "key0")

    def extend(batches):
        shape = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            out = []
            for a, b, d, starts in zip(*(batch.column(c) for c in ("lines", "lines0", "diagonal", "starts")), strict=True):
                a, b, done, runs = a.values.to_numpy(), b.values.to_numpy(), -1, []
                for i in starts.as_py():
                    if i >= done:
                        lo, done = same_run(a, b, i, i - d.as_py())
                        runs.append({"start": lo, "end": done})
                out.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(out, pa.list_(shape))], names=["id", "text_hash", "runs"])

    columns = ("id", "text_hash", "lines", "lines0", "diagonal", "starts")
    runs = full.select(*columns).mapInArrow(extend, f"id {kind}, text_hash long, runs array<struct<start:int,end:int>>")
    return runs.groupBy("id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def without_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_lines, n_removed, n_words_removed, text) for every row: lines count those with a word, text is what is left."""
    kind = docs.schema[id].dataType.simpleString()
    runs = settle(repeated_runs(docs, id=id, text=text, min_words=min_words), "runs")
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    # Merged at any size: the number of documents with repeats follows the corpus, so this side is not for broadcast.
    found = runs.withColumnRenamed("id", "_id").withColumnRenamed("text_hash", "_hash").hint("merge")
    rows = rows.join(found, rows.id.eqNullSafe(F.col("_id")) & (rows.text_hash == F.col("_hash")), "left").select("id", "text", "runs")

    def cut(batches):
        for batch in batches:
            lines, removed, words, texts = [], [], [], []
            for t, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                parts = (t or "").split("\n")
                full = [i for i, x in enumerate(parts) if x.encode().split()]
                gone = {full[j] for r in runs or () for j in range(r["start"], r["end"])}
                lines.append(len(full))
                removed.append(len(gone))
                words.append(sum(len(parts[i].encode().split()) for i in gone))
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else t)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (lines, removed, words)), pa.array(texts, pa.string())],
                                             names=["id", "n_lines", "n_removed", "n_words_removed", "text"])

    return rows.mapInArrow(cut, f"id {kind}, n_lines long, n_removed long, n_words_removed long, text string").withColumnRenamed("id", id)
