"""N-gram Jaccard join with set-relation skipping: exact links between word-shingle sets, as components.

A document's set is its distinct ``k``-word shingles (the whole sequence if it has fewer words), in one global order: a
shingle that many documents hold comes late. Two sets with Jaccard similarity of at least ``percent`` / 100 share a
shingle in the short prefixes of that order, so only prefixes are indexed. Equal sets are one node from the start.

* *Index lists are skipped by block and position.* Entries of a list lie in size blocks; a set meets only its own and the
  neighbouring block, and a pair is dropped when the places of its shared shingle leave too few shingles behind it.
* *Answers come from a similar set's answers.* In every block the first set leads: others are compared with it alone, and
  sets that similar leaders connect are a family. Each family is compared with its root (the least set) and with the member
  nearest to the root. Sets linked to the same one are in one component, and pairs inside
  a component need no comparison. Inside a large family each set then meets its nearest one, round by round. Only what
  these answers leave open is compared pair by pair: inside a family in blocks of ``chunk`` sets (a block pair is one
  group, so a large family spreads over many tasks), between families through the lists.

Parity signatures of 1,024 bits, and histograms of long sets, rule out most pairs exactly (they never differ by more than
the sets differ in elements); the rest is decided on whole sets, which are read again from the texts for those pairs only. So every pair that could link is
compared, or known to be connected.

Defined cases: a null text or a text without words has an empty set, is linked with nothing and is its own component;
repeated rows are linked by their equal sets; rows with a null doc_id take part, and the smallest id that is not null
names the component; an empty table gives an empty result. A node is a 64-bit hash of its set.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm import words as wd
from barframe.llm.components import components
from barframe.plans.settle import release, settle

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 18
CHUNK = 1024
ROUNDS = 4
LEADERS = 3
FEW_PAIRS = 2000  # from here on all pairs are taken at once: it saves rounds, and changes no result
BITS = 1024
LONG = 512
BUCKETS = 512
FAMILY_PERCENT = 50


def shingle_sets(texts: pa.Array, k: int):
    """For each row of a batch in turn: its sorted distinct shingle hashes."""
    for _, _, w in wd.batch_words(texts, plain=False, lower=True):
        grams, at = w.grams(k)
        first = np.searchsorted(at, w.first)
        counts = w.counts()
        for r in range(len(counts)):
            if counts[r] >= k:
                yield np.unique(grams[first[r] : first[r + 1]])
            elif counts[r]:
                a, b = w.first[r], w.first[r + 1]
                yield wd.gram_hash([w.hash[a:b][j : j + 1] for j in range(b - a)])
            else:
                yield np.empty(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    total = np.array([len(s)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + wd.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(wd.mix(total).view(np.int64)[0])


def needed(na, nb, percent: int):
    """Smallest intersection of sets of these sizes that links them (a Column)."""
    return F.ceil((na + nb) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))


def signature(s: np.ndarray) -> np.ndarray:
    """``BITS`` bits, each the parity of a share of the set: two signatures differ in no more bits than the sets in elements."""
    at = (wd.mix(s ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def histogram(s: np.ndarray) -> np.ndarray | None:
    """Of a long set, how many of its elements fall into each of ``BUCKETS`` shares (127 at most); they differ less than the sets."""
    if len(s) <= LONG:
        return None
    at = (wd.mix(s ^ np.uint64(0x1B873593CC9E2D51)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=BUCKETS), 127).astype(np.int8)


def _scanned(docs: DataFrame, id: str, text: str, k: int) -> DataFrame:
    """A row (id, text_hash, node, n, sig, hist) for each document; and rows (bucket, uses): documents by bucket of shingles."""
    kind = docs.schema[id].dataType

    def scan(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        kind_ = pa.null()
        for batch in batches:
            kind_ = batch.schema.field("id").type
            node, size, sig, hist = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                size.append(len(s))
                if not len(s):
                    node.append(None)
                    sig.append(None)
                    hist.append(None)
                    continue
                node.append(node_of(s))
                sig.append(signature(s))
                hist.append(histogram(s))
                np.add.at(total, (s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), 1)
            rows = len(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(node, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(sig, pa.list_(pa.int64())), pa.array(hist, pa.list_(pa.int8())), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())], names=names)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 65536):
            part = at[lo : lo + 65536]
            rows = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(rows, kind_), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()),
                 pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int8())), pa.array(part, pa.int32()), pa.array(total[part])], names=names)

    names = ["id", "text_hash", "node", "n", "sig", "hist", "bucket", "uses"]
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(wd.lean(scan), f"id {kind.simpleString()}, text_hash long, node long, n long, sig array<long>, hist array<tinyint>, bucket int, uses long")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """Number of documents for each of 2^SKETCH_BITS buckets of shingles: fixed size, whatever the corpus."""
    rows = scanned.filter("bucket is not null").groupBy("bucket").agg(F.sum("uses").alias("n")).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    sketch[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return sketch


def _prefixes(docs: DataFrame, text: str, k: int, percent: int, sketch) -> DataFrame:
    """(token, node, n, pos): the prefix of each set in the global order."""

    def index(batches):
        order = sketch.value
        for batch in batches:
            tokens, nodes, sizes, places = [], [], [], []
            seen = set()
            for s in shingle_sets(batch.column(0), k):
                n = len(s)
                node = node_of(s)
                if n and node not in seen:
                    seen.add(node)
                    p = n - -(-n * percent // 100) + 1
                    near = s[np.argsort(order[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)], kind="stable")[:p]]
                    tokens.append(near.view(np.int64))
                    nodes.append(np.full(p, node, dtype=np.int64))
                    sizes.append(np.full(p, n, dtype=np.int32))
                    places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield from wd.sliced(pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, nodes, sizes, places)], names=["token", "node", "n", "pos"]))

    return docs.select(F.col(text).alias("text")).mapInArrow(wd.lean(index), "token long, node long, n int, pos int")


def _contents(docs: DataFrame, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(node, s) of the sets of the wanted texts (text_hash), read again from one text of each.

    ``wanted`` is settled, so its size is known: while it is small it is broadcast and no other text is moved.
    """
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])

    def fill(batches):
        for batch in batches:
            kept = [s for s in shingle_sets(batch.column(0), k) if len(s)]
            flat = np.concatenate(kept).view(np.int64) if kept else np.empty(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in kept], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "s"])

    return texts.select("text").mapInArrow(wd.lean(fill), "node long, s array<long>")


def _signed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``near``, an estimate of their similarity, and ``maybe``: false where the signatures rule a link out."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ga"), F.col("hist").alias("ha"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("gb"), F.col("hist").alias("hb"))
    both = F.col("na") + F.col("nb")
    apart = sum((F.bit_count(F.col("ga")[i].bitwiseXOR(F.col("gb")[i])) for i in range(BITS // 64)), F.lit(0))
    guess = -F.lit(BITS / 2) * F.log(F.greatest(1 - 2 * F.col("apart") / F.lit(float(BITS)), F.lit(1e-3)))
    far = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda t, x: t + x)
    out = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", apart.alias("apart"), far.alias("far"))
    # Differences add up to far only where a bucket's do not cancel: for many, far is about 0.8 sqrt(BUCKETS * apart).
    guess = F.coalesce(F.greatest(F.col("far").cast("double"), F.col("far") * F.col("far") / F.lit(0.64 * BUCKETS)), guess)
    guess = F.least(guess, both.cast("double"))
    apart = F.greatest("apart", F.coalesce("far", F.lit(0)))
    return out.select("a", "b", ((both - guess) / (both + guess)).alias("near"), (apart <= both - 2 * needed(F.col("na"), F.col("nb"), percent)).alias("maybe"))


def _links(docs: DataFrame, text: str, k: int, percent: int, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    pairs = settle(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "text_hash"), "node")
    wanted = settle(wanted.select("text_hash"), "wanted")
    sets = settle(_contents(docs, text, k, wanted), "sets")
    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    sizes = full.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    links = settle(sizes.filter(F.col("shared") * (100 + percent) >= F.col("total") * percent).select("a", "b"), "links")
    release(pairs, wanted, sets)
    return links


def _inside(members: DataFrame, percent: int, chunk: int, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of one family that differ in root and that their signatures leave open, from (node, n, sig, hist, family, root).

    ``nearest`` gives for each set the pair with its nearest set only, in each meeting of blocks. Blocks of ``chunk`` sets meet blocks: each meeting is a group of its own, so a large family spreads over many tasks.
    """
    counts = members.groupBy("family").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    parts = F.ceil(F.col("size") / F.lit(float(chunk))).cast("int").alias("parts")
    # Written first, so few open families are broadcast and their members are not dealt by family.
    open_ = members.join(settle(counts.filter("r0 <> r1").select("family", parts), "families"), "family")
    placed = open_.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    meet = F.expr("transform(sequence(0, parts - 1), o -> struct(least(o, part) as i, greatest(o, part) as j))")
    rows = placed.withColumn("at", F.explode(meet)).select("node", "n", "sig", "hist", "family", "root", "part", "at.i", "at.j")

    def compare(table: pa.Table) -> pa.Table:
        part, i, j, n, root, node = (table.column(c).to_numpy() for c in ("part", "i", "j", "n", "root", "node"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        hist = {r: np.array(h, dtype=np.int16) for r, h in enumerate(table.column("hist").to_pylist()) if h is not None}
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, len(left), 64):
            x = left[lo : lo + 64]
            apart = sum(np.bitwise_count(sig[x, w][:, None] ^ sig[right, w][None, :]).astype(np.int64) for w in range(sig.shape[1]))
            total = n[x][:, None] + n[right][None, :]
            shared = np.ceil(total * percent / (100 + percent) - 1e-9).astype(np.int64)
            small = np.minimum(n[x][:, None], n[right][None, :])
            open_ = (apart <= total - 2 * shared) & (small >= shared) & (root[x][:, None] != root[right][None, :])
            for u, v in zip(*np.nonzero(open_), strict=True) if hist else ():
                a_, b_ = hist.get(x[u]), hist.get(right[v])
                if a_ is not None and b_ is not None and np.abs(a_ - b_).sum() > total[u, v] - 2 * shared[u, v]:
                    open_[u, v] = False
            if nearest:
                apart = np.where(open_, apart, 1 << 30)
                pick = np.zeros_like(open_)
                pick[np.arange(len(x)), apart.argmin(axis=1)] = True
                if i[0] != j[0]:
                    pick[apart.argmin(axis=0), np.arange(len(right))] = True
                open_ &= pick
            u, v = np.nonzero(open_)
            a.append(np.minimum(node[x[u]], node[right[v]]))
            b.append(np.maximum(node[x[u]], node[right[v]]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")


def _across(lists: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different families and roots that share a list, after the block and position filters."""
    open_ = lists.join(known.select("node", "family", "root"), "node")
    live = open_.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("family").alias("f0"), F.max("family").alias("f1"))
    open_ = settle(open_.join(live.filter("r0 <> r1 and f0 <> f1").select("token"), "token"), "open")
    cols = ("node", "n", "pos", "family", "root", "block")
    low = open_.select("token", *[F.col(c).alias(f"{c}_a") for c in cols])
    low = low.union(low.withColumn("block_a", F.col("block_a") + 1))
    high = open_.select("token", *[F.col(c).alias(f"{c}_b") for c in cols])
    alpha = needed(F.col("n_a"), F.col("n_b"), percent)
    room = F.lit(1) + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    meet = (low.token == high.token) & (F.col("block_a") == F.col("block_b")) & (F.col("family_a") != F.col("family_b")) & (F.col("root_a") != F.col("root_b"))
    meet = meet & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b"))))
    meet = meet & (room >= alpha) & (F.col("n_a") >= alpha)
    return low.join(high, meet).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _families(pairs: DataFrame) -> DataFrame:
    """(node, family) from pairs (a, b, near) of sets with leaders: sets that similar leaders connect, named by the least."""
    return components(pairs.filter(F.col("near") >= FAMILY_PERCENT / 100).select("a", "b")).toDF("node", "family")


def _grouped(docs: DataFrame, id: str, text: str, k: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """(id, text_hash, n, root, component_id) for every row; root is the node that stands for the component, null without words."""
    scanned = settle(_scanned(docs, id, text, k), "scanned")
    named = scanned.filter("bucket is null").select("id", "text_hash", "node", "n", "sig", "hist")
    nodes = named.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("hist").alias("hist"))
    nodes = settle(nodes, "nodes")
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(scanned))

    # Entries of lists in which a set meets another of its own or a neighbouring size block.
    entries = settle(_prefixes(docs, text, k, percent, sketch), "entries")
    many = entries.groupBy("token").agg(F.count("*").alias("uses")).filter("uses > 1").select("token")
    step = -math.log(percent / 100) * (1 + 1e-9)  # sizes of neighbouring blocks reach to 1 / 0.85
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    lists = entries.join(many, "token").groupBy("token", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    all_lists = settle(lists.withColumn("block", block), "lists")
    release(entries)
    held = all_lists.groupBy("token", "block").agg(F.count("*").alias("sets"))
    held = held.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1))).groupBy("token", "block").agg(F.sum("sets").alias("sets"))
    lists = settle(all_lists.join(held.filter("sets > 1").select("token", "block"), ["token", "block"]), "lists")
    release(all_lists)
    # Joins with signatures move the sets in lists only.
    members = settle(nodes.drop("least").join(lists.select("node").distinct(), "node", "left_semi"), "members")

    # 1. Each entry against the leaders of its block and of the block above: the first by a hash, the same in all lists.
    rank = F.struct(F.xxhash64("node").alias("rank"), "node", "n", "pos")
    leaders = lists.groupBy("token", "block").agg(F.min(rank).alias("lead"))
    leaders = leaders.select("token", "block", "lead").union(leaders.select("token", F.col("block") - 1, "lead"))
    alpha = needed(F.col("n"), F.col("lead.n"), percent)
    room = F.lit(1) + F.least(F.col("n") - F.col("pos") - 1, F.col("lead.n") - F.col("lead.pos") - 1)
    met = lists.join(leaders, ["token", "block"]).filter((F.col("node") != F.col("lead.node")) & (F.least("n", F.col("lead.n")) >= alpha))
    met = met.groupBy("node", F.col("lead.node").alias("lead")).agg(F.count("*").alias("lists"), F.max(room >= alpha).alias("may"))
    # Pairs that may link; and for the families the leaders that a set meets most often.
    often = F.slice(F.sort_array(F.collect_list(F.struct("lists", F.xxhash64("lead").alias("rank"), "lead", "may")), asc=False), 1, LEADERS)
    met = settle(met, "met")
    pairs = met.filter("may").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    pairs = pairs.union(met.groupBy("node").agg(often.alias("o")).select("node", F.explode("o.lead"))).distinct()
    first = settle(_signed(pairs, members, percent), "leaders")
    home = _families(first)

    # 2. Each family against its root, then against the member nearest to the root.
    second = settle(_signed(home.filter("node <> family").select(F.col("node").alias("a"), F.col("family").alias("b")), members, percent), "roots")
    near = second.groupBy("b").agg(F.max_by("a", F.struct("near", "a")).alias("nearest")).withColumnRenamed("b", "family")
    third = _signed(home.join(near, "family").filter("node <> nearest").select(F.col("node").alias("a"), F.col("nearest").alias("b")), members, percent)
    maybe = first.union(second).union(third).filter("maybe").select("a", "b")
    links = _links(docs, text, k, percent, maybe, members)
    found = components(links)

    # 3. What is still open: inside families in blocks, between families through the lists.
    known = lists.select("node").distinct().join(home, "node", "left").join(found, "node", "left")
    known = known.select("node", F.coalesce("family", "node").alias("family"), F.coalesce("root", "node").alias("root"))
    known = settle(known.join(members.select("node", "n", "sig", "hist"), "node"), "known")
    for _ in range(ROUNDS):
        # In a large family each set first meets its nearest one, which joins most of what belongs together.
        pairs = settle(_inside(known, percent, chunk, nearest=True), "nearest")
        if pairs.count() <= FEW_PAIRS:
            break
        new = _links(docs, text, k, percent, pairs, members)
        if new.isEmpty():
            break
        links = links.union(new)
        found = components(links)
        known = settle(known.drop("root").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "known")
    open_ = _signed(_across(lists, known, percent), members, percent).filter("maybe").select("a", "b").union(_inside(known, percent, chunk))
    open_ = settle(open_, "open")
    whole = found
    if not open_.isEmpty():
        whole = components(links.union(_links(docs, text, k, percent, open_, members)))
    tops = nodes.join(whole, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named_by = tops.groupBy("root").agg(F.min("least").alias("component_id"))
    result = tops.join(named_by, "root").select("node", "root", "component_id")
    return named.join(result, "node", "left").select("id", "text_hash", "n", "root", F.coalesce("component_id", "id").alias("component_id"))


def jaccard_components(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row; component_id is the smallest id reachable by links."""
    return _grouped(docs, id, text, k, percent).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays, all columns kept.

    Among the component's rows with that id the one with the smallest text hash stays, and one of rows that repeat it.
    Components are told apart by their root: unlinked texts under one id, or under none, all stay. Documents without words
    are no copies of each other and stay.
    """
    own = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own)
    key, body = own[docs.columns.index(id)], own[docs.columns.index(text)]
    found = settle(_grouped(docs, id, text, k, percent), "groups")
    least = found.filter("n > 0 and id <=> component_id").groupBy("root", "component_id").agg(F.min("text_hash").alias("text_hash"))
    kept = least.select(F.xxhash64("text_hash", "component_id").alias("_kept"))
    plain = plain.withColumn("_kept", F.xxhash64(F.xxhash64(body), F.col(key)))
    some = F.coalesce(F.col(body).rlike(wd.SPACED), F.lit(False))
    full = plain.filter(some).join(kept, "_kept", "left_semi").dropDuplicates(["_kept"])
    return full.select(*own).union(plain.filter(~some).select(*own)).toDF(*docs.columns)
