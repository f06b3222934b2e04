"""Token counts that follow edits: a segment tree per document, and only the touched regions are encoded again.

A tree's leaves are stretches of about ``LEAF`` white-space words; its nodes (a heap: node i has children 2i and 2i + 1) hold the
characters and tokens below them. The tokenizer never joins tokens over white space, and a leaf begins at a word after
white space, so leaves count on their own. An edit (start, length, insert) replaces characters of the text as it was
before the batch of edits. The tree finds the leaves it touches, one character of context on each side included (white space
that goes or comes joins or splits words there); neighbouring regions merge. The texts of these regions are encoded again
after the edits, and the sums on the paths to the root are updated. All other leaves keep their counts.

Texts with ``<|`` before or after the edits (added tokens) are counted whole.

Defined cases: a null or empty text has one empty leaf and 0 tokens; edits are taken by start, then length, then insert, and one that
begins inside the stretch of an earlier one is skipped; starts and ends beyond the text are cut to it; an edit with a null
start is skipped, a null length is 0 and a null insert is empty; edits of unknown documents do nothing. Rows that repeat
id and text are counted and edited one by one. An edit names its document by id; all rows with the id are edited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm import words as wd
from barframe.llm.tokenfile import encoder
from barframe.plans.settle import settle

LEAF = 32


class Tree:
    """Sums of characters and tokens over leaves, as heaps of a power-of-two width."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        """From stored heaps."""
        self.chars, self.tokens = np.array(chars, dtype=np.int64), np.array(tokens, dtype=np.int64)
        self.width = len(self.chars) // 2

    def find(self, place: int) -> int:
        """The leaf that holds character ``place``; the last leaf with characters beyond the end."""
        i, place = 1, min(place, max(0, int(self.chars[1]) - 1))
        while i < self.width:
            i *= 2
            if place >= self.chars[i]:
                place -= int(self.chars[i])
                i += 1
        return i - self.width

    def start(self, leaf: int) -> int:
        """Characters before a leaf."""
        i, before = leaf + self.width, 0
        while i > 1:
            if i % 2:
                before += int(self.chars[i - 1])
            i //= 2
        return before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.width
        chars, tokens = chars - int(self.chars[i]), tokens - int(self.tokens[i])
        while i and (chars or tokens):
            self.chars[i] += chars
            self.tokens[i] += tokens
            i //= 2


def heap(leaves: np.ndarray) -> np.ndarray:
    width = 1 << max(0, int(len(leaves) - 1).bit_length())
    out = np.zeros(2 * width, dtype=np.int64)
    out[width : width + len(leaves)] = leaves
    for i in range(width - 1, 0, -1):
        out[i] = out[2 * i] + out[2 * i + 1]
    return out


def _leaves(own, data: np.ndarray, offsets: np.ndarray, leaf: int):
    """For each row: characters and tokens of its leaves."""
    lo = int(offsets[0])
    raw = data[lo : int(offsets[-1])]
    chunks, cuts = own.chunks(data, offsets)
    kept = own.known(chunks)
    tokens = np.concatenate([[0], np.cumsum(own.sizes[kept])])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    words = wd.words(data, offsets, plain=False, lower=False)
    for r in range(len(offsets) - 1):
        a, b = int(offsets[r]) - lo, int(offsets[r + 1]) - lo
        if b"<|" in raw[a:b].tobytes():
            yield np.array([chars[b] - chars[a]]), np.array([len(own.tokenizer.encode(raw[a:b].tobytes().decode(), add_special_tokens=False).ids)])
            continue
        starts = words.start[words.first[r] : words.first[r + 1]][leaf::leaf]
        bounds = np.concatenate([[a], starts, [b]])
        wide = bounds + np.searchsorted(cuts, bounds, "left")
        at = chunks.first[r] + np.searchsorted(chunks.start[chunks.first[r] : chunks.first[r + 1]], wide, "left")
        yield np.diff(chars[bounds]), np.diff(tokens[at])


def count_tokens(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id, text_hash, n_tokens, chars, tokens): the tree of every row, as heaps."""
    kind = docs.schema[id].dataType.simpleString()

    def count(batches):
        own = encoder(tokenizer)
        for batch in batches:
            data, offsets = wd.buffers(batch.column("text"))
            chars, tokens = [], []
            for lo, hi in wd.groups(offsets):
                for c, t in _leaves(own, data, offsets[lo : hi + 1], leaf):
                    chars.append(heap(c))
                    tokens.append(heap(t))
            heaps = [pa.array(x, pa.list_(pa.int64())).cast(pa.list_(pa.int32())) for x in (chars, tokens)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array([int(t[1]) for t in tokens], pa.int64()), *heaps],
                                             names=["id", "text_hash", "n_tokens", "chars", "tokens"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(count, f"id {kind}, text_hash long, n_tokens long, chars array<int>, tokens array<int>").withColumnRenamed("id", id)


def clean_edits(edits: list[dict], size: int) -> list[tuple[int, int, str]]:
    """Edits as (start, end, insert), sorted, inside the text and apart."""
    rows = sorted((max(0, min(e["start"], size)), max(0, e["length"] or 0), e["insert"] or "") for e in edits if e["start"] is not None)
    out, done = [], 0
    for start, length, insert in rows:
        if start >= done:
            done = min(size, start + length)
            out.append((start, done, insert))
    return out


def edited(text: str, edits: list[tuple[int, int, str]], start: int = 0) -> str:
    """``text``, which begins at character ``start``, after the edits."""
    parts, at = [], start
    for a, b, insert in edits:
        parts += [text[at - start : a - start], insert]
        at = b
    return "".join(parts) + text[at - start :]


def touched(text: str, tree: Tree, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(first leaf, last leaf, new text) of the regions that the edits touch, with a character of context on both sides.

    A text in which ``<|`` stands before or after the edits is one region: a special token may cross any border.
    """
    regions: list[list] = []
    for e in edits:
        first, last = tree.find(max(0, e[0] - 1)), tree.find(min(len(text), e[1] + 1))
        if regions and first <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], last)
            regions[-1][2].append(e)
        else:
            regions.append([first, last, [e]])
    out = []
    for first, last, own in regions:
        a, b = tree.start(first), tree.start(last) + int(tree.chars[last + tree.width])
        out.append((first, last, edited(text[a:b], own, a)))
    if out and ("<|" in text or any("<|" in new for _, _, new in out)):
        return [(0, tree.width - 1, edited(text, edits))]
    return out


def replace(tree: Tree, regions: list[tuple[int, int, str]], counts) -> int:
    """Put the new characters and tokens of the regions into the tree; returns the number of characters encoded again."""
    for (first, last, new), n in zip(regions, counts, strict=True):
        for leaf in range(first + 1, last + 1):
            tree.put(leaf, 0, 0)
        tree.put(first, len(new), int(n))
    return sum(len(new) for _, _, new in regions)


def token_counts(own, texts: list[str]) -> np.ndarray:
    """Number of tokens of each text, all encoded together."""
    return np.concatenate([np.zeros(0, np.int64), *(sizes for _, _, sizes in own.encode(pa.array(texts, pa.large_string())))])


def recount(own, text: str, tree: Tree, edits: list[tuple[int, int, str]]) -> int:
    """Update the tree of one text for the edits; returns the number of characters encoded again."""
    regions = touched(text, tree, edits)
    return replace(tree, regions, token_counts(own, [new for _, _, new in regions]))


def apply_edits(docs: DataFrame, state: DataFrame, edits: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_before, n_edits, n_after, n_reencoded, chars, tokens) for every row of ``state``.

    ``edits`` has (id, start, length, insert), starts and lengths in characters. Documents without edits keep their trees; only
    the texts of the others are read. text_hash is that of the text before the edits.
    """
    kind = docs.schema[id].dataType.simpleString()
    listed = edits.select(F.col(id).alias("id"), F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("insert").cast("string").alias("insert")).alias("e"))
    listed = settle(listed.filter("id is not null and e.start is not null").groupBy("id").agg(F.collect_list("e").alias("edits")), "edits")
    # The ids alone pick the rows first, so what is not edited need not move while they are few.
    ids = settle(listed.select("id"), "edited")
    texts = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    # Encoding costs far more than its bytes tell, so the rows are dealt to a fixed number of tasks, which is not reduced by size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(tasks, "id", "text_hash").dropDuplicates(["id", "text_hash"]).join(listed, "id")
    trees = state.withColumnRenamed(id, "id")
    # Rows that repeat id and text have equal trees; their number is kept.
    rows = trees.join(ids, "id", "left_semi").join(texts, ["id", "text_hash"])

    def update(batches):
        own = encoder(tokenizer)
        for batch in batches:
            done, regions, trees = [], [], []
            for t, c, k, e in zip(*(batch.column(x) for x in ("text", "chars", "tokens", "edits")), strict=True):
                tree, t = Tree(c.values.to_numpy(), k.values.to_numpy()), t.as_py() or ""
                todo = clean_edits(e.as_py(), len(t))
                done.append(len(todo))
                regions.append(touched(t, tree, todo))
                trees.append(tree)
            counts = iter(token_counts(own, [new for found in regions for _, _, new in found]))
            again = [replace(tree, found, [next(counts) for _ in found]) for tree, found in zip(trees, regions, strict=True)]
            chars, tokens = [t.chars for t in trees], [t.tokens for t in trees]
            heaps = [pa.array(x, pa.list_(pa.int64())).cast(pa.list_(pa.int32())) for x in (chars, tokens)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), batch.column("n_tokens"), pa.array(done, pa.int64()),
                 pa.array([int(t[1]) for t in tokens], pa.int64()), pa.array(again, pa.int64()), *heaps], names=names)

    names = ["id", "text_hash", "n_before", "n_edits", "n_after", "n_reencoded", "chars", "tokens"]
    schema = f"id {kind}, text_hash long, n_before long, n_edits long, n_after long, n_reencoded long, chars array<int>, tokens array<int>"
    new = rows.select("id", "text_hash", "text", "n_tokens", "chars", "tokens", "edits").mapInArrow(update, schema)
    zero = F.lit(0).cast("long")
    same = trees.join(ids, "id", "left_anti")
    same = same.select("id", "text_hash", F.col("n_tokens").alias("n_before"), zero.alias("n_edits"), F.col("n_tokens").alias("n_after"), zero.alias("n_reencoded"), "chars", "tokens")
    return new.unionByName(same).withColumnRenamed("id", id)


#: What the scrubbing edits replace: addresses, long hex keys and runs of digits.
SCRUBBED = ((r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "<email>"), (r"\b[0-9a-f]{16,}\b", "<key>"), (r"\+?\d[\d ().-]{7,}\d", "<number>"))


def scrub_edits(docs: DataFrame, *, id: str = "doc_id", text: str = "text", patterns=SCRUBBED) -> DataFrame:
    """(id, start, length, insert): edits that replace what the patterns match, in characters; of matches that overlap the earlier pattern's counts."""
    kind = docs.schema[id].dataType.simpleString()

    def find(batches):
        import bisect
        import re

        compiled = [(re.compile(p), insert) for p, insert in patterns]
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans: list[tuple[int, int, str]] = []
                for p, insert in compiled if t else ():
                    starts, ends = [s[0] for s in spans], [s[1] for s in spans]
                    for m in p.finditer(t):
                        at = bisect.bisect_right(starts, m.start())
                        if (at and ends[at - 1] > m.start()) or (at < len(starts) and starts[at] < m.end()):
                            continue
                        spans.append((*m.span(), insert))
                    spans.sort()
                rows += [(i, a, b - a, insert) for a, b, insert in spans]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("id").type), *(pa.array(c, pa.int64()) for c in cols[1:3]), pa.array(cols[3], pa.string())],
                                             names=["id", "start", "length", "insert"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(find, f"id {kind}, start long, length long, insert string").withColumnRenamed("id", id)
