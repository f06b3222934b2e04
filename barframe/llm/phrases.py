"""Phrase collocations per language from Rabin-Karp fingerprints of word n-grams.

Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces, and pieces at spaces and tabs into words. A batch's words are
hashed with numpy (``words``: a prefix polynomial over bytes), and every n-gram from prefix polynomials over the word values: two
cumulative sums per batch, with different odd bases, give two independent 64-bit fingerprints of any n-gram by one subtraction. The first
one is the key, the second one tells collisions apart. The language is mixed into both.

Three scans of the texts count words, pairs, then triples and fours. Each scan emits, combined per task block, (fingerprint, count, second
fingerprint, place of an occurrence); Spark sums them, keeps the least place and keeps fingerprints with ``least`` occurrences.
An n-gram can only be that frequent if both of its parts that are one word shorter are, so a scan skips n-grams whose parts are
missing from a bit table of the frequent fingerprints. The table is built by Spark's bitmap aggregate, has ``bits.BITS_EACH`` bits per
fingerprint and ``MAX_BITS`` bits at most (32 MB); beyond that it lets more n-grams through, and the counts stay what they are.

A place is one 64-bit number, ``KEY_BITS`` bits of the text's hash and the index of the first word, so sums, places and second
fingerprints are plain longs and Spark aggregates them by hash. Only the texts that frequent fingerprints point at are read for their words, and
the words found there are hashed again: a fingerprint whose occurrences differ in the second fingerprint, or whose place does not
show it (texts with equal key bits are all tried; an index beyond the bits left points nowhere), counts as collided. The n-grams of collided fingerprints are counted by their text in one more scan, so the counts are exact.
Frequent phrases alone become text; cuts and containment are then joins on the phrases themselves.

Defined cases: a null or empty text has no words; a null language is ``und`` and counts with it; repeated rows count each time; ties in the
ranking end at the phrase, which is unique in its language; an empty table gives no rows; very long texts go in pieces (``words``), n-grams
across the pieces included. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm import words as wd
from barframe.llm.bits import MAX_BITS, known
from barframe.plans.settle import release, settle

LEAST = 30
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
CONTAINED = 80
BLOCK = 1 << 19
GROUP = 1 << 20
KEY_BITS = 36
BASES = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)
CUTS = b".,;:!?\n\x0b\x0c\r"

_to = np.arange(256, dtype=np.uint8)
_to[65:91] += 32
_inside = np.ones(256, dtype=bool)
_inside[np.frombuffer(CUTS + b" \t", np.uint8)] = False
_cut = np.zeros(256, dtype=bool)
_cut[np.frombuffer(CUTS, np.uint8)] = True


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    store = wd.worker_store()
    got = store.get(("powers", base))
    if got is None or len(got[0]) <= n:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n + 1, 1 << 18), b, dtype=np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=np.uint64))
        got = store[("powers", base)] = tuple(pair)
    return got


class Grams:
    """Fingerprints of the n-grams of some rows; ``seed`` is one 64-bit value per row (its language)."""

    def __init__(self, w: wd.Words, seed: np.ndarray, bits: int = 64):
        self.w, self.rows = w, w.rows()
        cuts = np.zeros(len(w.data) + 1, dtype=np.int32 if len(w.data) < 1 << 31 else np.int64)
        np.cumsum(_cut[w.data], out=cuts[1:])
        self.piece = cuts[w.start]
        self.seed = seed
        self.mask = np.uint64((1 << bits) - 1)
        self.sums, self.back = [], []
        for base in BASES:
            power, back = _powers(base, len(w.hash))
            total = np.zeros(len(w.hash) + 1, dtype=np.uint64)
            np.cumsum(w.hash * power[: len(w.hash)], out=total[1:])
            self.sums.append(total)
            self.back.append(back)

    def places(self, k: int) -> np.ndarray:
        """Indices of the first words of all n-grams of k words."""
        n = len(self.w.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero((self.rows[:n] == self.rows[k - 1 :]) & (self.piece[:n] == self.piece[k - 1 :]))

    def of(self, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        total, back = self.sums[which], self.back[which]
        h = wd.mix((total[at + k] - total[at]) * back[at] + self.seed[self.rows[at]] + np.uint64(k))
        return h & self.mask if which == 0 else h


def cut(texts: pa.Array):
    """(first row, last row, words) of the rows of a batch."""
    data, offsets = wd.buffers(texts)
    for lo, hi in wd.groups(offsets, GROUP):
        yield lo, hi, wd.words(data, offsets[lo : hi + 1], plain=False, lower=True, rule=(_to, _inside))


def seeds(langs: pa.Array) -> np.ndarray:
    """A 64-bit value for each row's language."""
    d = langs.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    if not len(d.dictionary):
        return np.empty(0, np.uint64)
    values = [int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in d.dictionary.to_pylist()]
    return np.array(values, dtype=np.uint64)[d.indices.to_numpy()]


def _combined(parts: list[tuple]) -> tuple:
    """One entry per fingerprint, second fingerprint and language: the count and the first of its places. Empties ``parts``."""
    fp, check, lang, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(fp, kind="stable")
    fp, check, lang = fp[order], check[order], lang[order]
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (fp[1:] != fp[:-1]) | (check[1:] != check[:-1]) | (lang[1:] != lang[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(fp)))
    return fp[first], check[first], lang[first], n, place[order[first]]


_COUNTED = "lang string, fp long, chk long, n long, place long, k int"
_AT = (1 << (63 - KEY_BITS)) - 1


def _scan(docs: DataFrame, sizes: tuple[int, ...], filters, fp_bits: int, block: int) -> DataFrame:
    """Counted fingerprints of the n-grams of the given sizes whose parts ``filters`` (broadcast Known or None) has."""

    def count(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names, seed, keys, code = langs.dictionary, seeds(batch.column("lang")), batch.column("key").to_numpy(), langs.indices.to_numpy()
            held = {k: [] for k in sizes}
            size = dict.fromkeys(sizes, 0)

            def emit(k):
                fp, check, lang, n, place = _combined(held[k])
                size[k] = 0
                for lo in range(0, len(fp), wd.ROWS):
                    to = min(lo + wd.ROWS, len(fp))
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(lang[lo:to])), pa.array(fp[lo:to].view(np.int64)), pa.array(check[lo:to].view(np.int64)), pa.array(n[lo:to]), pa.array(place[lo:to]), pa.array(np.full(to - lo, k, np.int32))],
                        names=["lang", "fp", "chk", "n", "place", "k"])

            for lo, hi, w in cut(batch.column("text")):
                if not len(w.hash):
                    continue
                g = Grams(w, seed[lo:hi], fp_bits)
                for k in sizes:
                    at = g.places(k)
                    if filters is not None and k > 1:
                        m = min(k - 1, filters.value[0])
                        for j in range(k - m + 1):
                            at = at[filters.value[1].has(g.of(at + j, m))]
                    rows = g.rows[at]
                    held[k].append((g.of(at, k), g.of(at, k, 1), code[lo:hi][rows], (keys[lo:hi][rows] << (63 - KEY_BITS)) + np.minimum(at - w.first[rows], _AT)))
                    size[k] += len(at)
                    if size[k] >= block:
                        yield from emit(k)
            for k in sizes:
                if size[k]:
                    yield from emit(k)

    return docs.select("lang", "key", "text").mapInArrow(count, _COUNTED)


def _frequent(counted: DataFrame, least: int) -> DataFrame:
    sums = counted.groupBy("lang", "k", "fp").agg(F.sum("n").alias("n"), F.min("chk").alias("chk"), (F.min("chk") != F.max("chk")).alias("mixed"), F.min("place").alias("place"))
    key, at = F.shiftright("place", 63 - KEY_BITS), F.col("place").bitwiseAND(F.lit(_AT))
    return sums.filter(F.col("n") >= least).select("lang", "k", "fp", "n", "chk", "mixed", key.alias("key"), at.alias("at"))


def _phrase(w: wd.Words, i: int, k: int) -> str:
    return " ".join(w.text(j).decode("utf-8", "replace") for j in range(i, i + k))


def _read_places(texts: DataFrame, frequent: DataFrame, fp_bits: int) -> DataFrame:
    """(lang, k, phrase, n, fp, same): the words at the place of each fingerprint, and whether they have it, once per text of the key."""
    spots = frequent.groupBy("key").agg(F.collect_list(F.struct("k", "at", "fp", "chk", "n", "mixed")).alias("spots"))
    pointed = texts.join(spots.select("key"), "key", "left_semi").groupBy("key", F.xxhash64("lang", "text").alias("whole")).agg(F.first(F.struct("lang", "text")).alias("doc"))

    def read(batches):
        for batch in batches:
            spots_of = batch.column("spots")
            seed = seeds(batch.column("lang"))
            out = {c: [] for c in ("lang", "k", "phrase", "n", "fp", "same")}
            langs = batch.column("lang").to_pylist()
            for lo, hi, w in cut(batch.column("text")):
                g = Grams(w, seed[lo:hi], fp_bits)
                for r in range(lo, hi):
                    for s in spots_of[r].as_py():
                        i, k = int(w.first[r - lo]) + s["at"], s["k"]
                        at = np.array([i])
                        inside = i + k <= w.first[r - lo + 1]
                        same = bool(inside and not s["mixed"] and g.of(at, k).view(np.int64)[0] == s["fp"] and g.of(at, k, 1).view(np.int64)[0] == s["chk"])
                        for c, v in zip(out, (langs[r], k, _phrase(w, i, k) if same else None, s["n"], s["fp"], same), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["lang"], pa.string()), pa.array(out["k"], pa.int32()), pa.array(out["phrase"], pa.string()), pa.array(out["n"], pa.int64()),
                 pa.array(out["fp"], pa.int64()), pa.array(out["same"], pa.bool_())], names=list(out))

    return pointed.join(spots, "key").select("key", "doc.lang", "doc.text", "spots").mapInArrow(read, "lang string, k int, phrase string, n long, fp long, same boolean")


def _by_text(docs: DataFrame, prints: DataFrame, fp_bits: int, sizes: tuple[int, ...], least: int) -> DataFrame:
    """Frequent phrases among the n-grams of collided fingerprints, counted by their text."""
    table = docs.sparkSession.sparkContext.broadcast(known(prints))

    def spell(batches):
        for batch in batches:
            seed, langs = seeds(batch.column("lang")), batch.column("lang").to_pylist()
            for lo, hi, w in cut(batch.column("text")):
                g = Grams(w, seed[lo:hi], fp_bits)
                for k in sizes:
                    at = g.places(k)
                    fp = g.of(at, k)
                    take = table.value.has(fp)
                    at, fp = at[take], fp[take]
                    got: dict = {}
                    for i, f in zip(at.tolist(), fp.view(np.int64).tolist(), strict=True):
                        phrase = (langs[lo + int(g.rows[i])], k, f, _phrase(w, i, k))
                        got[phrase] = got.get(phrase, 0) + 1
                    if got:
                        lang, ks, fps, text = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(ks, pa.int32()), pa.array(fps, pa.int64()), pa.array(text, pa.string()), pa.array(list(got.values()), pa.int64())],
                                                         names=["lang", "k", "fp", "phrase", "n"])

    spelled = docs.select("lang", "text").mapInArrow(spell, "lang string, k int, fp long, phrase string, n long")
    spelled = spelled.join(prints.select("lang", "k", "fp"), ["lang", "k", "fp"], "left_semi")
    return spelled.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, fp_bits: int = 64,
                     block: int = BLOCK, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, n): all phrases of 1 to ``longest`` words found ``least`` times, (lang, n_words)), both settled.

    ``fp_bits`` shortens the first fingerprint (tests force collisions with it).
    """
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text is not null")
    d = d.withColumn("key", F.shiftrightunsigned(F.xxhash64("lang", "text"), 64 - KEY_BITS))
    kinds: list[DataFrame] = []
    before = None
    for sizes in ((1,), (2,), tuple(range(3, longest + 1))):
        sizes = tuple(k for k in sizes if k <= longest)
        if not sizes:
            continue
        counted = _scan(d, sizes, before, fp_bits, block)
        if sizes == (1,):
            counted = settle(counted.groupBy("lang", "k", "fp", "chk").agg(F.sum("n").alias("n"), F.min("place").alias("place")), "words")
            totals = settle(counted.groupBy("lang").agg(F.sum("n").alias("n_words")), "totals")
            found = settle(_frequent(counted, least), "frequent")
            release(counted, sweep=False)
        else:
            found = settle(_frequent(counted, least), "frequent")
        kinds.append(found)
        if sizes[-1] < longest:
            if before is not None:
                before.destroy()
            before = spark.sparkContext.broadcast((sizes[-1], known(found, max_bits=max_bits)))
    if before is not None:
        before.destroy()
    frequent = kinds[0]
    for f in kinds[1:]:
        frequent = frequent.union(f)
    read = settle(_read_places(d, frequent, fp_bits), "phrases")
    release(*kinds, sweep=False)
    shown = read.groupBy("lang", "k", "fp").agg(F.max(F.when(F.col("same"), F.col("phrase"))).alias("phrase"), F.max("n").alias("n"))
    phrases, collided = shown.filter("phrase is not null").select("lang", "k", "phrase", "n"), shown.filter("phrase is null").select("lang", "k", "fp")
    if not collided.isEmpty():
        more = _by_text(d, collided, fp_bits, tuple(range(1, longest + 1)), least)
        phrases = phrases.union(more).groupBy("lang", "k", "phrase").agg(F.max("n").alias("n"))
    phrases = settle(phrases, "phrases")
    release(read, sweep=False)
    return phrases, totals


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, scale: int = SCALE,
                 contained: int = CONTAINED, **search) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, count and phrase.

    The score of a cut is floor(scale * a / (l + r)), of a phrase the lowest of its cuts (the first of equal ones). A phrase inside a
    longer one that has ``contained`` % of its occurrences is left out. ``search`` goes to ``frequent_phrases``.
    """
    phrases, totals = frequent_phrases(docs, text=text, lang=lang, least=least, longest=longest, **search)
    words = F.split("phrase", " ")
    part = lambda lo, size: F.array_join(F.slice("w", lo, size), " ")
    candidates = phrases.filter("k > 1").withColumn("w", words).withColumnRenamed("n", "a")
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = candidates.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c"))
    ends = cuts.select("lang", "phrase", "a", "c", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("c")).alias("part")), F.struct(F.lit(1).alias("side"), part(F.col("c") + 1, F.col("k") - F.col("c")).alias("part")))).alias("e"))
    ends = ends.select("lang", "phrase", "a", "c", "e.*").join(counts, ["lang", "part"])
    sided = ends.groupBy("lang", "phrase", "c").agg(F.max("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"(cast(a as decimal(25,0)) * {scale}) div (cast(l as decimal(25,0)) + r)").cast("long")
    best = sided.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "c", "a", "l", "r")).alias("best"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("k") - s + 1), lambda lo: F.array_join(F.slice("w", lo, s), " "))))
    holders = candidates.filter("k > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    holders = holders.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.select("lang", "phrase", "best.*").join(holders, ["lang", "phrase"], "left")
    inside = F.coalesce(F.col("longer").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(38,0)") * contained, F.lit(False))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # First among a 32nd of the phrases, so that the task of a language gets 32 * top rows at most.
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    left = left.filter(~inside).withColumn("near", F.row_number().over(near)).filter(F.col("near") <= top).drop("near")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    found = settle(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score"), "collocations")
    release(phrases, totals, sweep=False)
    return found
