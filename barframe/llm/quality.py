"""Quality scores from histogram gradient-boosted trees over document statistics.

Each text is read whole, once: ``STATISTICS`` numbers per document are taken with numpy from its bytes and words (shares of symbols,
capitals, digits and marks, repeats of lines, words and word triples, word and line lengths, variety). No other column is read.

The model is fitted on a bounded sample, at most ``SAMPLE`` labelled rows outside the hold-out, chosen by a hash of the id among all
labelled ids that the table has; their statistics alone reach the driver (``SAMPLE`` x ``len(STATISTICS)`` numbers). Values are put into
at most ``BINS`` bins at sample quantiles; every tree grows level by level to ``DEPTH``: gradients and curvatures of the log loss are
summed by (node, statistic, bin) in one ``bincount``, and prefix sums over bins give every split's gain. A tree is stored as a complete binary tree in
flat arrays (statistic, threshold, leaf value), so scoring walks all documents of a batch down one level per numpy step.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; rows without a usable label (null, or another
number) teach nothing; an id labelled both ways counts as label 0; labels of one kind only give their share as the score of every text,
no label at all 0.5; repeated rows get equal scores; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm import words as wd
from barframe.plans.settle import release, settle

SAMPLE = 20_000
BINS = 64
DEPTH = 4
TREES = 80
RATE = 0.15
RIDGE = 1.0
LEAST_CURVATURE = 2.0
THRESHOLD = 0.5
STATISTICS = (
    "log_words", "mean_word", "sd_word", "log_longest_word", "symbols", "exclamations", "stops", "commas", "capitals", "digits", "wide_bytes", "other_marks",
    "symbol_ends", "capital_starts", "short_words", "distinct_words", "top_word", "repeated_triples", "log_lines", "words_per_line", "repeated_lines", "marked_line_ends",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


_SYMBOLS, _UPPER, _DIGITS, _STOPS = _table(b"#*$%&|<>"), _table(wd.UPPER.encode()), _table(b"0123456789"), _table(b".!?")
_LETTERS = _UPPER | _table(wd.LOWER.encode())
_WIDE = np.arange(256) >= 128
_MARKS = np.array([33 <= b < 127 for b in range(256)]) & ~(_SYMBOLS | _LETTERS | _DIGITS | _table(b".,!?"))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive bounds."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), bounds)).astype(np.float64)


def _repeats(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: different values, occurrences of values found twice or more, occurrences of the commonest."""
    order = np.lexsort((h, rows))
    r, v = rows[order], h[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    first = np.flatnonzero(new)
    count, owner = np.diff(np.append(first, len(r))), r[first]
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    return np.bincount(owner, minlength=n), np.bincount(owner, weights=np.where(count > 1, count, 0), minlength=n), top


def _line_hashes(w: wd.Words, newlines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each line that has words; ``newlines`` counts line ends before each byte."""
    line = newlines[w.start]
    rows = w.rows()
    new = np.ones(len(line), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
    return first, np.add.reduceat(wd.mix(w.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    data, offsets = wd.buffers(texts)
    for lo, hi in wd.groups(offsets):
        bounds, n = offsets[lo : hi + 1] - offsets[lo], hi - lo
        w = wd.words(data, offsets[lo : hi + 1], plain=False, lower=False)
        if not len(w.hash):
            continue
        b, rows, count = w.data, w.rows(), w.counts().astype(np.float64)
        some, letters = np.maximum(count, 1), np.maximum(_sums(_LETTERS[b], bounds), 1)
        size = (w.end - w.start).astype(np.float64)
        chars = np.bincount(rows, weights=size, minlength=n)
        mean = chars / some
        longest = np.zeros(n)
        np.maximum.at(longest, rows, size)
        spread = np.sqrt(np.maximum(np.bincount(rows, weights=size * size, minlength=n) / some - mean * mean, 0))
        by_word = lambda flags: np.bincount(rows, weights=flags, minlength=n) / some  # noqa: B023, E731
        by_byte = lambda flags: _sums(flags[b], bounds)  # noqa: B023, E731
        different, _, top = _repeats(rows, w.hash, n)
        grams, at = w.grams(3)
        owner = rows[at]
        _, again, _ = _repeats(owner, grams, n) if len(grams) else (0, np.zeros(n), 0)
        newlines = np.zeros(len(b) + 1, dtype=np.int64)
        np.cumsum(b == 10, out=newlines[1:])
        first, line = _line_hashes(w, newlines)
        lines = np.bincount(rows[first], minlength=n).astype(np.float64)
        kinds, _, _ = _repeats(rows[first], line, n)
        last = np.append(first[1:], len(w.hash)) - 1
        ended = np.bincount(rows[first], weights=_STOPS[b[w.end[last] - 1]], minlength=n)
        out[lo:hi] = np.stack([
            np.log1p(count), mean, spread, np.log1p(longest), by_byte(_SYMBOLS) / some, by_byte(_table(b"!")) / some, by_byte(_table(b".?")) / some, by_byte(_table(b",")) / some,
            by_byte(_UPPER) / letters, by_byte(_DIGITS) / np.maximum(chars, 1), by_byte(_WIDE) / np.maximum(chars, 1), by_byte(_MARKS) / some,
            by_word(_SYMBOLS[b[w.end - 1]]), by_word(_UPPER[b[w.start]]), by_word(size <= 3), different / some, top / some, again / np.maximum(count - 2, 1),
            np.log1p(lines), count / np.maximum(lines, 1), (lines - kinds) / np.maximum(lines, 1), ended / np.maximum(lines, 1)], axis=1)
    return out


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: children of node i are 2 i + 1 (value <= threshold) and 2 i + 2; one row of each array per tree."""

    statistic: np.ndarray  # tree x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # tree x leaves
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, at = np.full(len(x), self.start), np.arange(len(x))
        inner = self.statistic.shape[1]
        for s, t, v in zip(self.statistic, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[at, s[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE,
        least: float = LEAST_CURVATURE) -> Trees:
    """Trees for the log odds of label 1."""
    m, width = x.shape[1], bins
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)], axis=1)
    slot = code + np.arange(m) * width
    usable = np.arange(width)[None, :] < np.array([len(e) for e in edges])[:, None]  # the last bin ends no split
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    inner = (1 << depth) - 1
    shape = (trees, inner)
    statistic, threshold, leaf = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros((trees, inner + 1))
    gain_of = lambda g, h: g * g / (h + ridge)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)  # within the level
        for level in range(depth):
            nodes = 1 << level
            cell = (node[:, None] * (m * width) + slot).ravel()
            hist = [np.bincount(cell, weights=np.repeat(v, m), minlength=nodes * m * width).reshape(nodes, m, width).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (ga, ha) = hist, (v[:, :, -1:] for v in hist)
            gain = gain_of(gl, hl) + gain_of(ga - gl, ha - hl) - gain_of(ga, ha)
            gain[(hl < least) | (ha - hl < least) | ~usable[None]] = 0
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(axis=1)
            real = flat[np.arange(nodes), best] > 1e-9
            f, c = best // width, best % width
            at = nodes - 1 + np.arange(nodes)
            statistic[t, at] = np.where(real, f, 0)
            threshold[t, at] = [edges[i][j] if ok else np.inf for i, j, ok in zip(f, c, real, strict=True)]
            node = 2 * node + (real[node] & (code[np.arange(len(y)), f[node]] > c[node]))
        gs, hs = (np.bincount(node, weights=v, minlength=inner + 1) for v in (g, h))
        leaf[t] = rate * gs / (hs + ridge)
        total += leaf[t][node]
    return Trees(statistic, threshold, leaf, start)


def held_out(id: str):
    """Rows that never teach: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(F.col(id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """The fitted trees. Only rows outside ``held_out`` are read."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).filter(~held_out("id") & F.col("y").isin(0, 1) & F.col("id").isNotNull())
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(~held_out("id"))
    known = known.groupBy("id").agg(F.min("y").alias("y")).join(rows.select("id"), "id", "left_semi")
    taken = settle(known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample), "sample")

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.join(taken, "id").select("y", "text").mapInArrow(measure, "y int, x array<double>").toArrow()
    release(taken, sweep=False)
    y = got["y"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else float(y[0])
        odds = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -9, 9))
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), odds)
    x = np.array(got["x"].combine_chunks().flatten()).reshape(len(y), -1)
    # Sums in a fixed order: reruns agree whatever the order in which the rows arrive.
    row = np.lexsort((y, *x.T))
    return fit(x[row], y[row])


def quality(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD,
            model: Trees | None = None) -> DataFrame:
    """(id, held_out, score, predicted) of every row; ``score`` is the probability of label 1."""
    model = model or train(docs, labels, id=id, text=text, label=label)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id].dataType.simpleString()

    def score(batches):
        for batch in batches:
            s = shared.value.scores(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s)], names=["id", "score"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(score, f"id {kind}, score double")
    return rows.select(F.col("id").alias(id), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD,
              model: Trees | None = None) -> DataFrame:
    """The documents whose score reaches the threshold, all columns kept."""
    model = model or train(docs, labels, id=id, text=text, label=label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            s = shared.value.scores(statistics(batch.column(batch.schema.get_field_index(text))))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(keep, docs.schema)
