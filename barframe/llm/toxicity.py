"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are given for documents, so tokens are labelled from the corpus first: over all labelled training rows (one of each
group of near copies) the document counts of each word and word start are taken (Spark aggregates), and those that the likelihood ratio ties to toxic
documents beyond chance (G2 above 2 ln M, M being the number of tested features; the strongest ``MARKS``) mark the toxic
tokens of toxic documents. Toxic documents without a marked token are counted again, in ``ROUNDS`` rounds at most, so that
tokens of rarer kinds stand out too.

The field has two states (other, toxic) on blocks of ``BLOCK`` words. Features of a token are its word, its first 4, 5 and 6
bytes; the states of its neighbours act through the transitions. It is fitted on a bounded sample: ``SAMPLE`` training rows per label, chosen by a hash
of the id, of at most ``SAMPLE_CHARS`` characters each (both are parameters). Scoring reads every word of every text:
forward-backward marginals give each word's probability p of being toxic. Words with p >= 0.5 are the offending spans; the sum
of their odds (or the largest odds if there is none) is the document's evidence, and a logistic curve through the evidence
of the sample turns its logarithm into the score.

Defined cases: a null or empty text has the least evidence, so the lowest score; rows without a usable label (null, or no such id) are scored all the same; an
id labelled both ways counts as toxic; without labels of both kinds every score is 0. Repeated rows are scored one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm import bits, jaccard
from barframe.llm import words as wd
from barframe.llm.bits import may_be_in
from barframe.plans.settle import release, settle

BLOCK = 64
PREFIXES = (4, 5, 6)
SAMPLE = 1200
SAMPLE_CHARS = 20_000
LEAST_DOCS = 4
MARKS = 20_000
THRESHOLD = 0.7
_BITS = 20
ROUNDS = 3
SHINGLE = 5
PERCENT = 80
BANDS = 8


def features(w: wd.Words) -> np.ndarray:
    """A row of feature hashes for each word: the word itself and its starts."""
    return np.stack([w.hash, *w.prefix])


def _distinct(doc: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((f, doc))
    doc, f = doc[order], f[order]
    new = np.ones(len(f), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (f[1:] != f[:-1])
    return doc[new], f[new]


def places(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Place of each word in a table of blocks (flat), and the number of blocks; a text starts a new block."""
    blocks = -(-counts // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    return np.repeat(first[:-1] * BLOCK, counts) + wd.runs(counts), int(first[-1])


def marginals(score: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the toxic state by position. ``move``: exp of the scores other-toxic, toxic-other, toxic-toxic.

    Returns (odds, forward ratio, backward ratio); a ratio is toxic to other.
    """
    x = np.exp(np.clip(score, -25, 25))
    a01, a10, a11 = move
    r, q = np.empty_like(x), np.ones_like(x)
    r[:, 0] = x[:, 0] * a01
    for t in range(1, x.shape[1]):
        r[:, t] = x[:, t] * (a01 + a11 * r[:, t - 1]) / (1 + a10 * r[:, t - 1])
    for t in range(x.shape[1] - 2, -1, -1):
        ahead = x[:, t + 1] * q[:, t + 1]
        q[:, t] = np.where(mask[:, t + 1], (a10 + a11 * ahead) / (1 + a01 * ahead), 1.0)
    return r * q, r, q


def fit(texts: list[str], toxic: list[int], marks: np.ndarray, epochs: int = 6, parts: int = 12, rate: float = 0.5, decay: float = 1e-5):
    """Fit the field on the sample: (feature hashes, weights, transition weights). ``marks``: sorted hashes of toxic features."""
    feats, counts, labels = [], [], []
    for lo, hi, w in wd.batch_words(pa.array(texts, pa.string()), plain=True, lower=True, prefixes=PREFIXES):
        f = features(w)
        own = np.zeros(len(w.hash), dtype=bool)
        for row in f:
            own |= np.isin(row, marks)
        feats.append(f)
        counts.append(w.counts())
        labels.append(own & (np.repeat(np.array(toxic[lo:hi]), w.counts()) == 1))
    counts, y = np.concatenate(counts), np.concatenate(labels).astype(np.float64)
    known, ids = np.unique(np.concatenate(feats, axis=1), return_inverse=True)
    ids = ids.reshape(-1, len(y))
    weight, step = np.zeros(len(known)), np.full(len(known), 1e-6)
    move, move_step = np.array([-3.0, 0.0, -3.0]), np.full(3, 1e-6)
    ends = np.concatenate([[0], np.cumsum(counts)])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for docs in np.array_split(order.permutation(len(counts)), parts):
            if not len(docs):
                continue
            at = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in docs])
            if not len(at):
                continue
            own, f, t = counts[docs], ids[:, at], y[at]
            where, n = places(own)
            table = np.zeros(n * BLOCK)
            table[where] = weight[f].sum(axis=0)
            mask = np.zeros(n * BLOCK, dtype=bool)
            mask[where] = True
            mask = mask.reshape(n, BLOCK)
            score, a = table.reshape(n, BLOCK), np.exp(move)
            odds, r, q = marginals(score, mask, a)
            p = (odds / (1 + odds)).ravel()[where]
            truth = np.zeros(n * BLOCK)
            truth[where] = t
            truth = truth.reshape(n, BLOCK)
            # Pairs of neighbours in a block; the first word follows the state "other".
            x = np.exp(np.clip(score, -25, 25))
            both = mask[:, 1:]
            ahead = x[:, 1:] * q[:, 1:]
            ot, to, tt = a[0] * ahead, a[1] * r[:, :-1], a[2] * r[:, :-1] * ahead
            z = 1 + ot + to + tt
            before, after = truth[:, :-1], truth[:, 1:]
            first = odds[:, 0] / (1 + odds[:, 0])
            g = np.array([
                (truth[:, 0] - first).sum() + (((1 - before) * after - ot / z) * both).sum(),
                ((before * (1 - after) - to / z) * both).sum(),
                ((before * after - tt / z) * both).sum()]) / len(at)
            error = np.broadcast_to((t - p)[None, :], f.shape)
            grad = np.bincount(f.ravel(), weights=error.ravel(), minlength=len(known)) / len(docs) - decay * weight
            step += grad * grad
            weight += rate * grad / np.sqrt(step)
            move_step += g * g
            move += 0.1 * rate * g / np.sqrt(move_step)
    keep = np.abs(weight) > 0.01
    return known[keep], weight[keep], move


def lookup_table(known: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by the low bits of the feature hash, with high bits of their owner; of two owners the heavier stays."""
    at = (known & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    order = np.argsort(np.abs(weight), kind="stable")
    table, owner = np.zeros(1 << _BITS, dtype=np.float32), np.zeros(1 << _BITS, dtype=np.uint32)
    table[at[order]] = weight[order]
    owner[at[order]] = (known[order] >> np.uint64(32)).astype(np.uint32)
    return table, owner


def word_probabilities(w: wd.Words, model: tuple) -> np.ndarray:
    table, owner, move = model
    score = np.zeros(len(w.hash), dtype=np.float64)
    for f in features(w):
        at = (f & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        score += np.where(owner[at] == (f >> np.uint64(32)).astype(np.uint32), table[at], 0)
    where, n = places(w.counts())
    grid = np.zeros(n * BLOCK)
    grid[where] = score
    mask = np.zeros(n * BLOCK, dtype=bool)
    mask[where] = True
    odds, _, _ = marginals(grid.reshape(n, BLOCK), mask.reshape(n, BLOCK), np.exp(move))
    odds = odds.ravel()[where]
    return odds / (1 + odds)


def text_evidence(texts: pa.Array, model: tuple | None):
    """(first row, evidence of each row, offending words as (row, byte start, byte end)) for consecutive rows of a batch."""
    for lo, hi, w in wd.batch_words(texts, plain=True, lower=True, prefixes=PREFIXES):
        if model is None or not len(w.hash):
            yield lo, np.full(hi - lo, np.log(1e-6)), []
            continue
        p = word_probabilities(w, model)
        rows = w.rows()
        odds = p / np.maximum(1 - p, 1e-9)
        top = np.zeros(hi - lo)
        np.maximum.at(top, rows, odds)
        hit = np.flatnonzero(p >= 0.5)
        score = np.log(1e-6 + np.where(top < 1, top, np.bincount(rows[hit], weights=odds[hit], minlength=hi - lo)))
        row_start = buffers_start(texts, lo, hi)
        yield lo, score, [(int(rows[i]), int(w.start[i] - row_start[rows[i]]), int(w.end[i] - row_start[rows[i]])) for i in hit]


def calibrated(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the evidence of sample texts (Newton steps, both labels weigh the same)."""
    x = np.stack([evidence, np.ones(len(evidence))])
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic != 1).sum()))
    line = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(line @ x, -30, 30)))
        slope = x @ (weight * (toxic - p)) - np.array([1e-4, 1e-6]) * line
        bend = (x * (weight * p * (1 - p))) @ x.T + np.diag([1e-4, 1e-6])
        move = np.linalg.solve(bend, slope)
        line += np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return float(line[0]), float(line[1])


def text_scores(texts: pa.Array, model: tuple | None):
    for lo, z, hits in text_evidence(texts, model and model[:3]):
        yield lo, np.zeros(len(z)) if model is None else 1 / (1 + np.exp(-np.clip(model[3] * z + model[4], -700, 700))), hits


def buffers_start(texts: pa.Array, lo: int, hi: int) -> np.ndarray:
    _, offsets = wd.buffers(texts.slice(lo, hi - lo))
    return offsets[:-1] - offsets[0]


def held_out(id) -> F.Column:
    """Rows that never teach: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(F.col(id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def _without_copies(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The labelled rows (id, text, toxic), one of each group of near copies with one label: the one whose set has the least hash.

    Equal sets of ``SHINGLE``-word shingles are one set. Of every set ``BANDS`` minimum hashes are taken; a set is compared with the least set that has
    the same minimum and label, never with the others of a group. A set goes if an exact comparison finds it at least ``PERCENT`` % similar to a lesser one, so
    texts that only share passages all stay, and so do texts without words. Copies share every word, so they would tie ordinary words of a
    copied toxic text to the label.
    """
    # Bit tables keep texts that take no part out of the shuffles; the joins behind them are exact.
    spark = rows.sparkSession
    known = settle(known, "known")
    near = rows.filter(may_be_in(bits.known(known.select(F.xxhash64("id").alias("fp"))), F.xxhash64("id"), spark))
    near = near.join(known, "id").withColumn("text_hash", F.xxhash64("text"))
    mine = settle(near.groupBy("id", "text_hash", "toxic").agg(F.first("text").alias("text")), "mine")

    def scan(batches):
        salts = wd.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            node, size, least, sig = [], [], [], []
            for s in jaccard.shingle_sets(batch.column("text"), SHINGLE):
                node.append(jaccard.node_of(s) if len(s) else None)
                size.append(len(s))
                least.append([int(wd.mix(s ^ x).min().view(np.int64)) for x in salts] if len(s) else None)
                sig.append(jaccard.signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), batch.column("toxic"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))],
                names=["id", "text_hash", "toxic", "node", "n", "least", "sig"])

    kind = mine.schema["id"].dataType.simpleString()
    scanned = mine.select("id", "text_hash", "toxic", "text").mapInArrow(wd.lean(scan), f"id {kind}, text_hash long, toxic int, node long, n long, least array<long>, sig array<long>")
    scanned = settle(scanned, "sets")
    place = F.struct("id", "text_hash")
    nodes = settle(scanned.filter("node is not null").groupBy("toxic", "node").agg(F.min(place).alias("place"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("sig").alias("sig")), "nodes")
    bands = nodes.select("toxic", "node", F.posexplode("least").alias("band", "value"))
    lead = bands.groupBy("toxic", "band", "value").agg(F.min("node").alias("other"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    pairs = bands.join(lead, ["toxic", "band", "value"]).filter("node <> other").select("toxic", "node", "other").distinct()
    mate = nodes.select("toxic", F.col("node").alias("other"), F.col("place").alias("place_b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    both = pairs.join(nodes.drop("least"), ["toxic", "node"]).join(mate, ["toxic", "other"])
    apart = F.aggregate(F.zip_with("sig", "sig_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    wanted = jaccard.needed(F.col("n"), F.col("n_b"), PERCENT)
    both = both.filter((F.least("n", "n_b") >= wanted) & (apart <= F.col("n") + F.col("n_b") - 2 * wanted))
    both = settle(both.select("toxic", "node", "place", "place_b"), "pairs")
    used = bits.known(both.select(F.explode(F.array("place", "place_b")).alias("p")).select(F.xxhash64("p.id", "p.text_hash").alias("fp")).distinct())
    texts = mine.filter(may_be_in(used, F.xxhash64("id", "text_hash"), spark)).dropDuplicates(["id", "text_hash"])
    at = lambda name, text: texts.select(F.struct("id", "text_hash").alias(name), F.col("text").alias(text))
    both = both.join(at("place", "a"), "place").join(at("place_b", "b"), "place_b")

    def verify(batches):
        for batch in batches:
            sets = zip(jaccard.shingle_sets(batch.column("a"), SHINGLE), jaccard.shingle_sets(batch.column("b"), SHINGLE), strict=True)
            keep = []
            for x, y in sets:
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("node")], names=["toxic", "node"]).filter(pa.array(keep, pa.bool_()))

    gone = settle(both.select("toxic", "node", "a", "b").mapInArrow(wd.lean(verify), "toxic int, node long").distinct(), "gone")
    # Of a set's rows one stays: all rows but those, and all rows of sets that are gone.
    copies = scanned.filter("node is not null").join(nodes.select("toxic", "node", "place"), ["toxic", "node"]).filter(place != F.col("place"))
    out = copies.select("id", "text_hash", "toxic").union(scanned.join(gone, ["toxic", "node"], "left_semi").select("id", "text_hash", "toxic"))
    out = settle(out.distinct(), "out")
    maybe = may_be_in(bits.known(out.select(F.xxhash64("id", "text_hash", "toxic").alias("fp"))), F.xxhash64("id", "text_hash", "toxic"), spark)
    marked = mine.withColumn("maybe", maybe)
    kept = marked.filter("not maybe").unionByName(marked.filter("maybe").join(out, ["id", "text_hash", "toxic"], "left_anti"))
    labelled = settle(kept.select("id", "text", "toxic"), "labelled")
    release(known, mine, scanned, nodes, gone, out, sweep=False)
    return labelled


def _fit_sample(marks: np.ndarray):
    """A task's work: the model of all rows (text, toxic) it gets, as one row of plain arrays; no row without both labels."""

    def work(batches):
        rows = sorted((-r["toxic"], r["text"] or "") for b in batches for r in b.to_pylist())
        texts, toxic = [x for _, x in rows], [-t for t, _ in rows]
        if len(set(toxic)) < 2:
            return
        hashes, weight, move = fit(texts, toxic, marks)
        evidence = np.concatenate([z for _, z, _ in text_evidence(pa.array(texts, pa.string()), (*lookup_table(hashes, weight), move))])
        numbers = [pa.array([x.tobytes()], pa.binary()) for x in (hashes, weight, move)]
        yield pa.RecordBatch.from_arrays([*numbers, pa.array([list(calibrated(evidence, np.array(toxic)))], pa.list_(pa.float64()))], names=["hashes", "weight", "move", "curve"])

    return work


def train(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE,
          sample_chars: int = SAMPLE_CHARS, marks_kept: int = MARKS):
    """A fitted model (plain arrays), or None without labels of both kinds. Only rows outside ``held_out`` are read."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("toxic")).filter(~held_out("id") & F.col("toxic").isin(0, 1))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).filter("id is not null")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(~held_out("id"))

    labelled = _without_copies(rows, known)

    def counted(marks):
        def count(batches):
            for batch in batches:
                toxic = batch.column("toxic").to_numpy()
                for lo, hi, w in wd.batch_words(batch.column("text"), plain=True, lower=True, prefixes=PREFIXES):
                    doc, f = w.rows(), features(w)
                    bad = toxic[lo:hi] == 1
                    known_by = np.zeros(hi - lo, dtype=bool)
                    for row in f:
                        known_by[doc[np.isin(row, marks)]] = True
                    use = ~(bad & known_by)
                    keep = use[doc]
                    pairs = [_distinct(doc[keep], row[keep]) for row in f]
                    docs_, found = (np.concatenate(x) for x in zip(*pairs, strict=True))
                    # Feature 0 counts the documents.
                    docs_, found = np.concatenate([docs_, np.flatnonzero(use)]), np.concatenate([found, np.zeros(use.sum(), np.uint64)])
                    got, at = np.unique(found, return_inverse=True)
                    t = np.bincount(at, weights=bad[docs_], minlength=len(got)).astype(np.int64)
                    c = np.bincount(at, minlength=len(got)) - t
                    yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(t), pa.array(c)], names=["feature", "t", "c"])

        return labelled.mapInArrow(wd.lean(count), "feature long, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))

    marks = np.empty(0, np.uint64)
    for _ in range(ROUNDS):
        counts = settle(counted(marks).filter((F.col("t") + F.col("c") >= LEAST_DOCS) | (F.col("feature") == 0)), "features")
        total = counts.filter("feature = 0").first()
        if total is None or not total.t or not total.c:
            break
        # G2 of toxic against other documents with and without the feature; only features more frequent in toxic ones.
        t, c, nt, nc = F.col("t"), F.col("c"), F.lit(float(total.t)), F.lit(float(total.c))
        all_ = nt + nc
        part = lambda o, row, col: F.when(o > 0, o * F.log(o * all_ / (row * col))).otherwise(0.0)  # noqa: B023, E731
        g2 = 2 * (part(t, t + c, nt) + part(c, t + c, nc) + part(nt - t, all_ - t - c, nt) + part(nc - c, all_ - t - c, nc))
        beyond = counts.filter((F.col("feature") != 0) & (t / nt > 9 * c / nc)).select("feature", g2.alias("g2"))
        beyond = beyond.filter(F.col("g2") > 2 * math.log(max(counts.count(), 2)))
        found = beyond.orderBy(F.desc("g2"), "feature").limit(marks_kept).select("feature").toArrow()["feature"].to_numpy()
        release(counts, sweep=False)
        if not len(found):
            break
        marks = np.union1d(marks, found.astype(np.int64).view(np.uint64))
    if not len(marks):
        release(labelled, sweep=False)
        return None

    order = F.xxhash64(F.col("id").cast("string"))
    short = labelled.filter(F.length("text") <= sample_chars)
    taken = short.filter("toxic = 1").orderBy(order, "id", "text").limit(sample).union(short.filter("toxic = 0").orderBy(order, "id", "text").limit(sample))
    # One task fits the bounded sample: 2 * sample texts of at most sample_chars characters.
    one = taken.select("text", "toxic").repartition(1)
    got = one.mapInArrow(wd.lean(_fit_sample(marks)), "hashes binary, weight binary, move binary, curve array<double>").collect()
    release(labelled, sweep=False)
    if not got:
        return None
    hashes, weight, move = np.frombuffer(got[0].hashes, np.uint64), np.frombuffer(got[0].weight, np.float64), np.frombuffer(got[0].move, np.float64)
    return (*lookup_table(hashes, weight), move, *got[0].curve)


def toxicity(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD,
             model: tuple | None = None) -> DataFrame:
    """(id, held_out, score, predicted, n_toxic_words, spans): spans are the offending words as byte offsets of the UTF-8 text."""
    model = model or train(docs, labels, id=id, text=text, label=label)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id].dataType.simpleString()

    def score(batches):
        for batch in batches:
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for lo, s, hits in text_scores(batch.column("text"), shared.value):
                scores[lo : lo + len(s)] = s
                for r, a, b in hits:
                    spans[lo + r].append({"start": a, "end": b})
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["id", "score", "spans"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(wd.lean(score), f"id {kind}, score double, spans array<struct<start:long,end:long>>")
    return rows.select(F.col("id").alias(id), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                       F.size("spans").cast("long").alias("n_toxic_words"), "spans")


def without_toxic(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD,
                  model: tuple | None = None) -> DataFrame:
    """The documents whose score is below the threshold, all columns kept."""
    model = model or train(docs, labels, id=id, text=text, label=label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for lo, s, _ in text_scores(batch.column(batch.schema.get_field_index(text)), shared.value):
                keep[lo : lo + len(s)] = s < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(wd.lean(clean), docs.schema)
