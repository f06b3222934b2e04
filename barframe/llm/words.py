"""Words of whole Arrow batches as numpy arrays: byte ranges, 64-bit hashes and rolling word n-grams.

A text is read as UTF-8 bytes. Every separator of both word rules is one ASCII byte, so words can be cut on bytes.
Work goes in pieces of about a quarter of a megabyte, cut at separators, so memory does not follow the length of a text.
A null text has no words. Equal words have equal hashes; different ones differ but for a chance of 2^-64 a pair.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
GROUP = 2 << 20
ROWS = 1 << 15

#: Java and Python patterns of the two word rules.
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def worker_store() -> dict:
    """Values that a Python worker keeps from task to task (tables that follow from constants, bounded caches)."""
    return sys.modules.setdefault("_barframe_llm_store", types.ModuleType("_barframe_llm_store")).__dict__


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], drop: tuple[str, ...] = ("encoder", "encoder_key")) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` for mapInArrow, without what an operator before it left in the worker; its own unused memory goes back when it ends.

    Workers live on from stage to stage. Arrow and the C library keep freed memory, so an idle worker would hold its largest batches
    while the executor sorts and joins.
    """

    def run(batches):
        for key in drop:
            worker_store().pop(key, None)
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Freed memory of this process to the system, where its allocators can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finishing steps of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    store = worker_store()
    got = store.get("powers")
    if got is None or len(got[0]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, PIECE + 1)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=np.uint64))
        got = store["powers"] = tuple(pair)
    return got


def byte_rule(plain: bool, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: what it is mapped to, and whether it belongs to a word."""
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[65:91] += 32
    if plain:
        inside = np.zeros(256, dtype=bool)
        inside[48:58] = inside[97:123] = inside[128:] = True
        inside = inside[to]
    else:
        inside = np.ones(256, dtype=bool)
        inside[32] = inside[9:14] = False
    return to, inside


@dataclass
class Words:
    """Words of some rows: byte range in ``data``, hash, and for each row the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of row i: first[i] .. first[i + 1]
    prefix: tuple[np.ndarray, ...] = ()  # hashes of the first bytes, for each wanted length

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one row, and the index of their first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        rows = self.rows()
        at = np.flatnonzero(rows[:n] == rows[k - 1 :])
        return gram_hash([self.hash[at + j] for j in range(k)]), at


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    g = parts[0].copy()
    for h in parts[1:]:
        g *= np.uint64(0xD6E8FEB86659FD93)
        g += h
    return mix(g)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls have length 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8), off


def groups(offsets: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def sliced(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``rows`` rows: the executor holds one part at a time outside its heap."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def words(data: np.ndarray, offsets: np.ndarray, plain: bool, lower: bool, prefixes: tuple[int, ...] = (), rule: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Words of consecutive rows. ``data`` is the column's buffer, ``offsets`` the rows' bounds in it. ``rule`` replaces ``byte_rule``."""
    to, inside = rule or byte_rule(plain, lower)
    lo, hi = int(offsets[0]), int(offsets[-1])
    own = to[data[lo:hi]] if lower else data[lo:hi]
    n = len(own)
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[offsets - lo] = True
    store = worker_store()
    if "bytes" not in store:
        store["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value = store["bytes"]
    starts, ends, found, heads = [], [], [], [[] for _ in prefixes]
    at = 0
    while at < n:
        to_ = min(at + PIECE, n)
        if to_ < n and not breaks[to_]:
            cut = np.flatnonzero(~inside[own[at:to_]] | breaks[at + 1 : to_ + 1])
            if len(cut):
                to_ = at + int(cut[-1]) + 1
            else:  # one word fills the piece
                while to_ < n and inside[own[to_]] and not breaks[to_]:
                    to_ += 1
        piece = own[at:to_]
        m = inside[piece]
        before = np.empty(len(m), dtype=bool)
        before[0] = False
        np.logical_and(m[:-1], ~breaks[at + 1 : to_], out=before[1:])
        s = np.flatnonzero(m & ~before)
        after = np.empty(len(m), dtype=bool)
        after[-1] = False
        np.logical_and(m[1:], ~breaks[at + 1 : to_], out=after[:-1])
        e = np.flatnonzero(m & ~after) + 1
        starts.append(s + at)
        ends.append(e + at)
        power, inverse = _powers(len(piece) + 1)
        v = value[piece]
        v *= power[: len(piece)]
        c = np.empty(len(piece) + 1, dtype=np.uint64)
        c[0] = 0
        np.cumsum(v, out=c[1:])
        base, back = c[s], inverse[s]
        found.append(mix((c[e] - base) * back))
        for k, own_heads in zip(prefixes, heads, strict=True):
            own_heads.append(mix((c[np.minimum(s + k, e)] - base) * back + np.uint64(k)))
        at = to_
    join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    s, e = join(starts, np.int64), join(ends, np.int64)
    first = np.searchsorted(s, offsets - lo, "left").astype(np.int64)
    return Words(own, s, e, join(found, np.uint64), first, tuple(join(x, np.uint64) for x in heads))


def batch_words(texts: pa.Array, plain: bool, lower: bool, limit: int = GROUP, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of a batch with their words."""
    data, offsets = buffers(texts)
    for lo, hi in groups(offsets, limit):
        yield lo, hi, words(data, offsets[lo : hi + 1], plain, lower, prefixes)


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
