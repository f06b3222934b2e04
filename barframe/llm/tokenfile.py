"""Token ids as fixed-width packed binary segments, in ascending document order.

A segment is one self-contained byte string (little-endian):

    magic b"BFTK", u16 version, u16 bits per id, u32 ids per block, u64 ids, u32 documents, u32 blocks
    u64 byte offset of each block in the payload
    u64 end of each document, in ids of this segment
    payload: each block starts on a byte, ids follow each other with ``bits`` bits, low bit first

``bits`` is the least that holds the vocabulary. Any id is found by its block offset, and a block unpacks with a few numpy
operations. Segments hold whole documents, about ``SEGMENT`` ids each (a longer document is a segment of its own). They are
rows of a Parquet dataset (part, segment, payload, ...), so Spark's writer commits them and any store that Spark
reaches can hold them; part and segment give the order.

Texts are sorted by range before they are encoded, so sampling the ranges encodes nothing. A tokenizer that drops white
space is asked once for each different chunk of a task: texts are cut at white space and between ASCII letters or digits
and ASCII marks (never at an apostrophe), where no token can cross; a test holds this against whole texts. Texts that
contain ``<|`` (added tokens) are encoded whole.

Defined cases: a null or empty text has the end id only; null ids come last; rows with one id follow each other by text hash;
an empty table writes no segment.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barframe.llm import words as wd
from barframe.plans.settle import new_path

MAGIC, VERSION = b"BFTK", 1
BLOCK = 4096
SEGMENT = 1 << 20
CACHED = 800_000
SLOT_BITS = 21
TOGETHER = 4096
_SLOTS = np.uint64((1 << SLOT_BITS) - 1)
END_ID = 2


def width(vocabulary: int) -> int:
    """Least number of bits for ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_segment(ids: np.ndarray, ends: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    parts = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)])[:-1] if parts else np.empty(0)
    head = MAGIC + np.array([VERSION, bits], "<u2").tobytes() + np.array([block], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    head += np.array([len(ends), len(parts)], "<u4").tobytes()
    return head + offsets.astype("<u8").tobytes() + np.asarray(ends).astype("<u8").tobytes() + b"".join(parts)


class Segment:
    """Reader of one segment: ``ids(a, b)`` unpacks only the blocks it needs."""

    def __init__(self, data: bytes):
        if data[:4] != b"BFTK" or int.from_bytes(data[4:6], "little") != 1:
            raise ValueError("not a token segment")
        self.bits, self.block = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:12], "little")
        self.count, self.docs, self.blocks = int.from_bytes(data[12:20], "little"), int.from_bytes(data[20:24], "little"), int.from_bytes(data[24:28], "little")
        at = 28
        self.offsets = np.frombuffer(data, "<u8", self.blocks, at).astype(np.int64)
        at += 8 * self.blocks
        self.ends = np.frombuffer(data, "<u8", self.docs, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * self.docs :]

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.empty(0, np.uint32)
        out = []
        for b in range(start // self.block, (end - 1) // self.block + 1):
            held = min(self.block, self.count - b * self.block)
            to = int(self.offsets[b + 1]) if b + 1 < self.blocks else len(self.payload)
            part = unpack(self.payload[int(self.offsets[b]) : to], held, self.bits)
            out.append(part[max(0, start - b * self.block) : end - b * self.block])
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class ChunkEncoder:
    """Ids of texts from the tokenizer's ids of their chunks; chunks are kept by hash, ``CACHED`` or one batch's at most."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.forget()

    def forget(self) -> None:
        """No chunks: arrays in the order of learning (the first entry is none), the keys sorted, and a table of the last learnt key by its low bits."""
        self.keys, self.starts, self.sizes = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat = np.empty(0, np.uint32)
        self.sorted, self.order = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.slot = np.zeros(1 << SLOT_BITS, np.int32)

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[wd.Words, np.ndarray]:
        """Chunks as words of a byte buffer with a space at every safe cut; and the cuts, as places in the original rows."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        own = data[lo:hi]
        kind = np.zeros(256, dtype=np.uint8)  # 1: ASCII letter or digit, 2: ASCII mark; others are never cut
        kind[33:127] = 2
        kind[48:58] = kind[65:91] = kind[97:123] = 1
        kind[39] = 0
        k = kind[own]
        at = np.flatnonzero((k[1:] + k[:-1] == 3) & (k[1:] != 0) & (k[:-1] != 0)) + 1
        wide = np.insert(own, at, 32)
        return wd.words(wide, offsets - lo + np.searchsorted(at, offsets - lo, "left"), plain=False, lower=True), at

    def learn(self, w: wd.Words, new: np.ndarray) -> None:
        """Encode the chunks at the given places of ``w``, in the order of their hashes, and keep their ids.

        Chunks go to the tokenizer as one text with spaces between them; a token belongs to the chunk that its first character is in.
        """
        for lo in range(0, len(new), TOGETHER):
            part = [w.text(i).decode() for i in new[lo : lo + TOGETHER]]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            first = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids))
            sizes = np.bincount(np.searchsorted(ends, first, "right"), minlength=len(part))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.array(got.ids, dtype=np.uint32)])
        keys, at = w.hash[new], len(self.keys) + np.arange(len(new))
        spot = np.searchsorted(self.sorted, keys)
        self.sorted, self.order = np.insert(self.sorted, spot, keys), np.insert(self.order, spot, at)
        self.slot[(keys & _SLOTS).astype(np.int64)] = at
        self.keys = np.concatenate([self.keys, keys])

    def known(self, w: wd.Words) -> np.ndarray:
        """Places of the chunks of ``w`` among the kept ones; new chunks are encoded first."""
        at = self.slot[(w.hash & _SLOTS).astype(np.int64)].astype(np.int64)
        miss = np.flatnonzero((self.keys[at] != w.hash) | (at == 0))
        if not len(miss):
            return at
        keys, first, back = np.unique(w.hash[miss], return_index=True, return_inverse=True)
        spot = np.searchsorted(self.sorted, keys)
        have = np.zeros(len(keys), dtype=bool)
        inside = spot < len(self.sorted)
        have[inside] = self.sorted[spot[inside]] == keys[inside]
        if not have.all():
            if len(self.keys) + int((~have).sum()) > CACHED and len(self.sorted):  # begin anew, with all chunks of this batch
                self.forget()
                return self.known(w)
            self.learn(w, miss[first[~have]])
            spot = np.searchsorted(self.sorted, keys)
        at[miss] = self.order[spot][back.ravel()]
        return at

    def encode(self, texts: pa.Array):
        """Yields (first row, ids of all rows, number of ids of each row) for consecutive rows."""
        data, offsets = wd.buffers(texts)
        for lo, hi in wd.groups(offsets):
            own = offsets[lo : hi + 1]
            special = [r for r in range(hi - lo) if b"<|" in data[own[r] : own[r + 1]].tobytes()] if b"<|" in data[own[0] : own[-1]].tobytes() else []
            w, _ = self.chunks(data, own)
            at = self.known(w)
            sizes, starts = self.sizes[at], self.starts[at]
            ids = self.flat[np.repeat(starts, sizes) + wd.runs(sizes)] if len(sizes) else np.empty(0, np.uint32)
            ends = np.concatenate([[0], np.cumsum(sizes)])[w.first]
            if special:
                parts = [ids[ends[r] : ends[r + 1]] for r in range(hi - lo)]
                for r in special:
                    text = data[own[r] : own[r + 1]].tobytes().decode()
                    parts[r] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                yield lo, np.concatenate(parts), np.array(list(map(len, parts)))
            else:
                yield lo, ids, np.diff(ends)


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file; tasks of one worker share its cache."""
    store = wd.worker_store()
    key = "encoder", path
    if store.get("encoder_key") != key:
        store["encoder"], store["encoder_key"] = ChunkEncoder(path), key
    return store["encoder"]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id: str = "doc_id", text: str = "text", end_id: int = END_ID,
                 segment: int = SEGMENT, block: int = BLOCK) -> None:
    """Encode every text and write the segments as a dataset at ``path``."""
    kind = docs.schema[id].dataType.simpleString()

    def write(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, names, held = [], [], [], 0
        own = encoder(tokenizer)
        bits = width(max(own.vocabulary, end_id + 1))

        def flush():
            nonlocal ids, sizes, names, held, number
            ends = np.cumsum(sizes)
            data = write_segment(np.concatenate(ids), ends, bits, block)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([int(ends[-1])], pa.int64()),
                 pa.array([names], pa.list_(names_type)), pa.array([data], pa.binary())],
                names=["part", "segment", "n_ids", "doc_ids", "payload"])
            ids, sizes, names, held, number = [], [], [], 0, number + 1
            return row

        names_type = None
        for batch in batches:
            names_type = batch.schema.field("id").type
            docs_ = batch.column("id").to_pylist()
            for lo, flat, counts in own.encode(batch.column("text")):
                at = 0
                for r, n in enumerate(counts):
                    if held and held + n + 1 > segment:
                        yield flush()
                    ids.append(flat[at : at + n])
                    ids.append(np.array([end_id], np.uint32))
                    sizes.append(int(n) + 1)
                    names.append(docs_[lo + r])
                    held += int(n) + 1
                    at += n
        if names:
            yield flush()

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_last(), F.xxhash64("text"))
    segments = rows.mapInArrow(wd.lean(write, drop=()), f"part int, segment int, n_ids long, doc_ids array<{kind}>, payload binary")
    segments.write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str, *, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the packed ids: start counts all ids before it."""
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    # One row for each part and segment: a running sum over the segments of a part, and one over the parts.
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = Window.partitionBy("part").orderBy("segment")
    starts = segments.select("part", "segment", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("inside"))
    rows = segments.join(starts.join(before, "part").select("part", "segment", (F.col("inside") + F.col("before")).alias("base")), ["part", "segment"])

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = Segment(batch.column("payload")[i].as_py())
                ids = held.ids(0, held.count).astype("<u4")
                starts = np.concatenate([[0], held.ends[:-1]])
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, held.ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(starts + batch.column("base")[i].as_py(), pa.int64()),
                     pa.array(held.ends - starts, pa.int64()), pa.array(sums, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"])

    out = rows.select("doc_ids", "payload", "base").mapInArrow(wd.lean(read), f"id {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id)


def token_digest(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the segments to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, id=id, text=text, end_id=end_id)
    return read_tokens(docs.sparkSession, path, id=id)
