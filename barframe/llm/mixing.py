"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents are aggregated by membership pattern (the sorted set of its sources),
so the flow problem has one node per pattern and one per source, whatever the number of documents. A pattern offers its
words once for each repetition, at costs that rise with the repetition (``2^k``: convex), and sends them to its sources,
whose quotas are the targets. Successive cheapest paths fill the quotas; by convexity a pattern repeats only when nothing
cheaper reaches the source. Sources that share no document are not brought together: their repetitions are filled in
order where they are, so their number has no bound; the flow takes the patterns around shared documents, ``MAX_PATTERNS``
of them at most. Documents are then chosen for each pattern: all of them for every full repetition, and for the
last one documents in the order of a seeded hash until the words are reached.

Targets: weights share all words; a source stops at ``most`` times its own words, the excess is shared among the others by
weight until none is above. The choice is made without moving a source's documents together: their words are summed in
hash ranges of about ``RANGE_ROWS`` rows, whole ranges are in or out, and only the range in which the words run out is
ordered; there a document that no longer fits is passed over, and of the last documents taken and the first passed over
(``POOL`` each) those stay whose sum is nearest.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; equal rows are ordered by their
position among equals; an empty table gives an empty result; sources without words get the target 0.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.llm import words as wd
from barframe.plans.settle import settle

MOST = 3
RANGE_ROWS = 4096
MAX_PATTERNS = 50_000
POOL = 12
SUMS = 200_000


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(wd.SPACED)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, most: int = MOST) -> dict:
    """The rule for a few sources, stated plainly; ``source_targets`` applies it to tables.

    Share all words by weight; nobody gets more than ``most`` times its size, the rest goes on by weight."""
    out, free, left = {}, sorted(sizes, key=lambda s: (s is None, s)), float(sum(sizes.values()))
    while free:
        whole = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] > most * sizes[s] * whole] if whole else free
        if not over:
            return out | {s: left * weights[s] / whole for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def nearest_sum(sizes: np.ndarray, aim: int) -> np.ndarray:
    """1 for the sizes whose sum is nearest to ``aim`` (the smaller of two), else 0."""
    most = aim + int(sizes.max(initial=0))
    came = {0: (-1, 0)}  # a sum that can be reached, by which size and from which sum
    for i, n in enumerate(sizes.tolist()):
        if len(came) > SUMS:  # with very long texts: near enough, and bounded
            break
        for s in [s for s in came if s + n <= most and s + n not in came]:
            came[s + n] = (i, s)
    best = min(came, key=lambda s: (abs(s - aim), s))
    out = np.zeros(len(sizes), dtype=np.int64)
    while best:
        i, best = came[best]
        out[i] = 1
    return out


def cyclic_weights(sources, cycle: tuple[int, ...] = (1, 2, 3)) -> dict:
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def cheapest_flow(supply: dict, quota: dict, most: int) -> dict:
    """Words by (pattern, repetition, source) of a min-cost flow; supply: pattern (a tuple of sources) to its words.

    Cheapest augmenting paths (Dijkstra on reduced costs) from repetitions with free words to sources with open quota.
    """
    flow: dict[tuple, int] = {}
    free = {(p, k): n for p, n in supply.items() for k in range(most) if n}
    need = {s: q for s, q in quota.items() if q > 0}
    into: dict[object, list] = {}
    for arc in free:
        for s in arc[0]:
            into.setdefault(s, []).append(arc)
    sent: dict[tuple, set] = {arc: set() for arc in free}
    if all(len(p) == 1 for p in supply):  # nothing overlaps: each source fills its repetitions in order
        for p, k in sorted(free, key=lambda a: a[1]):
            n = min(free[p, k], need.get(p[0], 0))
            if n:
                flow[p, k, p[0]] = n
                need[p[0]] -= n
        return flow
    # A path starts at the sink's side: source s may draw on any repetition of its patterns with free words, or take over
    # words that such a repetition sends to another source, which then draws on. All costs sit on the first use of a word.
    for s in sorted(need, key=lambda s: (s is None, s or "")):
        while need[s] > 0:
            best, come, heap, count = {s: 0}, {s: None}, [(0, 0, s)], 0
            goal, price = None, None
            while heap:
                cost, _, at = heapq.heappop(heap)
                if cost > best[at] or (price is not None and cost >= price):
                    continue
                for arc in into.get(at, ()):
                    if free[arc] and (price is None or cost + 2 ** arc[1] < price):
                        goal, price = (at, arc), cost + 2 ** arc[1]
                    for other in sent[arc]:
                        if other != at and (other not in best or cost < best[other]):
                            best[other], come[other] = cost, (at, arc)
                            count += 1
                            heapq.heappush(heap, (cost, count, other))
            if goal is None:
                break
            steps, at = [], goal[0]
            while come[at] is not None:
                steps.append((come[at][0], come[at][1], at))
                at = come[at][0]
            n = min([need[s], free[goal[1]], *(flow[arc[0], arc[1], other] for _, arc, other in steps)])
            for taker, arc, other in steps:
                flow[arc[0], arc[1], other] -= n
                if not flow[arc[0], arc[1], other]:
                    sent[arc].discard(other)
                flow[arc[0], arc[1], taker] = flow.get((arc[0], arc[1], taker), 0) + n
                sent[arc].add(taker)
            at, arc = goal
            flow[arc[0], arc[1], at] = flow.get((arc[0], arc[1], at), 0) + n
            sent[arc].add(at)
            free[arc] -= n
            need[s] -= n
    return {k: v for k, v in flow.items() if v}


def source_targets(patterns: DataFrame, weights: dict | None = None, most: int = MOST, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, words, target) of every source, as ``targets`` gives them, for any number of sources.

    Only sums reach the driver: the level of words per weight rises until no further source is above its bound.
    """
    spark = patterns.sparkSession
    sources = patterns.select(F.explode("pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("words"))
    if weights is None:
        # The place in code point order: places within the sorted parts, and the numbers of rows of the parts before.
        placed = settle(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()), "sources")
        part = F.shiftright("at", 33)
        before, done = [], 0
        for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
            before.append((r.part, done))
            done += r["count"]
        before = spark.createDataFrame(before, "part long, before long")
        place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
        weight = F.get(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle)).cast("int"))
        sized = placed.withColumn("part", part).join(before, "part").select("source", "words", weight.alias("weight"))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "name string, weight double")
        sized = sources.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "words", "weight")
        lacking = [r.source for r in sized.filter("weight is null").limit(5).collect()]
        if lacking:
            raise ValueError(f"sources without a weight: {lacking}")
    sized = settle(sized, "weights")
    sums = lambda free: sized.agg(F.sum("words").alias("all"), F.sum(F.when(~free, F.col("words"))).alias("full"), F.sum(F.when(free, F.col("weight"))).alias("whole"), F.count_if(~free).alias("n")).first()
    above, n = F.lit(False), -1
    while True:
        got = sums(~above)
        if got.n == n or not got.whole:
            break
        n, left, whole = got.n, float((got.all or 0) - most * (got.full or 0)), float(got.whole)
        above = F.lit(left) * F.col("weight") > F.col("words") * F.lit(most * whole)
    if n < 0:  # no source, or none with a weight
        return sized.select("source", "words", (F.col("words") * most).cast("double").alias("target"))
    share = F.lit(left) * F.col("weight") / F.lit(whole)
    return settle(sized.select("source", "words", F.when(above, (F.col("words") * most).cast("double")).otherwise(share).alias("target")), "targets")


def _plan(patterns: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(pattern, full, rest, ranges, source_size, target): full repetitions of a pattern and the words of its last one.

    A source that shares no document fills its repetitions in order, and needs no flow. Only patterns around shared documents
    are brought together, at most ``MAX_PATTERNS`` of them.
    """
    spark = patterns.sparkSession
    several, own = F.size("pattern") > 1, F.col("pattern")[0].eqNullSafe(F.col("source"))
    ranges = F.greatest(F.lit(1), F.floor(F.col("n") / RANGE_ROWS)).cast("long")
    single = patterns.filter(~several)
    shared = patterns.filter(several)
    near = None
    if not shared.isEmpty():
        linked = settle(shared.select(F.explode("pattern").alias("source")).distinct(), "linked")
        near = shared.unionByName(single.join(linked, own, "left_semi"))
        single = single.join(linked, own, "left_anti")
    taken = F.least(F.bround("target").cast("long"), F.lit(most) * F.col("words"))
    size = F.col("words")
    plan = single.join(sources.withColumnRenamed("words", "source_words"), own).select(
        "pattern", F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("long").alias("full"), F.when(size > 0, taken % size).otherwise(0).cast("long").alias("rest"),
        ranges.alias("ranges"), size.alias("source_size"), "target")
    if near is None:
        return plan
    found = near.select("pattern", "words", "n", ranges.alias("ranges")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns around shared documents; merge rare sources first")
    facts = sources.join(linked.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).collect()
    aim, sizes = {r.source: r.target for r in facts}, {r.source: r.words for r in facts}
    supply = {tuple(r.pattern): int(r.words) for r in found}
    words = dict.fromkeys(supply, 0)
    for (p, _, _), n in cheapest_flow(supply, {s: round(t) for s, t in aim.items()}, most).items():
        words[p] += n
    rows = []
    for r in found:
        p = tuple(r.pattern)
        full, rest = divmod(words[p], supply[p]) if supply[p] else (0, 0)
        rows.append((list(p), full, rest, r.ranges, sum(sizes[s] for s in p), float(sum(aim[s] for s in p))))
    return plan.unionByName(spark.createDataFrame(rows, "pattern array<string>, full long, rest long, ranges long, source_size long, target double"))


def mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", sources: Column | str = "source", weights: dict | None = None,
        most: int = MOST, seed: int = 0) -> DataFrame:
    """(id, text_hash, pattern, size, source_size, target, copies, taken) for every row.

    ``sources`` is a string or an array column. source_size and target are sums over the row's sources. ``weights`` by
    source; by default 1, 2, 3, 1, ... in code point order. copies is the number of times the row is taken as a whole.
    """
    spark = docs.sparkSession
    source = F.col(sources) if isinstance(sources, str) else sources
    if docs.select(source).schema[0].dataType.typeName() != "array":
        source = F.array(source)
    pattern = F.sort_array(F.array_distinct(F.transform(source, lambda x: x.cast("string"))), asc=True)
    pattern = F.when(F.size(pattern) > 0, pattern).otherwise(F.array(F.lit(None).cast("string")))
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.coalesce(pattern, F.array(F.lit(None).cast("string"))).alias("pattern"), word_count(F.col(text)).alias("size"))
    place = F.xxhash64(F.lit(seed), F.col("id").cast("string"), "text_hash")
    rows = settle(rows.withColumn("place", place), "sizes")

    patterns = settle(rows.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "patterns")
    plan = settle(_plan(patterns, source_targets(patterns, weights, most), most), "plan")
    key = F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"})
    plan = plan.select(key.alias("key"), "full", "rest", "ranges", "source_size", "target")

    # The range of a row among the ranges of its pattern, by the upper bits of its place.
    share = F.shiftrightunsigned("place", 33).cast("double") / F.lit(float(1 << 31))
    placed = rows.withColumn("key", key).join(plan, "key").withColumn("range", F.floor(share * F.col("ranges")))
    ranges = settle(placed.groupBy("key", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "ranges")
    upto = ranges.select("key", "range", "words", "rest", _running(ranges))
    cut = settle(upto.select("key", "range", F.when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("words") >= F.col("rest"), 0).otherwise(-1).alias("state"),
                             (F.col("rest") - F.col("upto") + F.col("words")).alias("room")), "cut")
    placed = placed.join(cut, ["key", "range"])
    whole = placed.filter("state >= 0").withColumn("extra", F.col("state").cast("long"))
    partly = placed.filter("state < 0")
    columns = ["id", "text_hash", "pattern", "size", "source_size", "target", "full", "place", "room", "key"]

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("size", "ascending")])
        size, left = table.column("size").to_numpy(), int(table.column("room")[0].as_py())
        extra = np.zeros(len(size), dtype=np.int64)
        for i, n in enumerate(size):
            if n <= left:
                extra[i], left = 1, left - n
        if left:  # the last documents taken and the first passed over are chosen anew, for the nearest sum
            full = np.flatnonzero(size > 0)
            pool = np.concatenate([full[extra[full] == 1][-POOL:], full[extra[full] == 0][:POOL]])
            aim = int(left + size[pool[extra[pool] == 1]].sum())
            extra[pool] = nearest_sum(size[pool], aim)
        return table.drop_columns(["room", "place", "key"]).append_column("extra", pa.array(extra))

    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, text_hash long, pattern array<string>, size long, source_size long, target double, full long, extra long"
    chosen = partly.select(*columns).groupBy("key").applyInArrow(choose, schema)
    out = whole.select("id", "text_hash", "pattern", "size", "source_size", "target", "full", "extra").union(chosen)
    copies = F.col("full") + F.col("extra")
    return out.select(F.col("id").alias(id), "text_hash", "pattern", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _running(ranges: DataFrame) -> Column:
    """Words up to and with a range of its pattern. A pattern has one row per ``RANGE_ROWS`` documents here."""
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum("words").over(order).alias("upto")


def mixed(docs: DataFrame, *, id: str = "doc_id", text: str = "text", sources: Column | str = "source", weights: dict | None = None,
          most: int = MOST, seed: int = 0) -> DataFrame:
    """The documents as often as the mix takes them, all columns kept. Documents of size 0 count nothing and are left out."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own)
    key, body = own[docs.columns.index(id)], own[docs.columns.index(text)]
    found = mix(docs, id=id, text=text, sources=sources, weights=weights, most=most, seed=seed).filter("taken > 0")
    # Equal rows may differ in copies: they are numbered on both sides.
    counts = settle(found.groupBy(F.col(id).alias("_id"), "text_hash").agg(F.sort_array(F.collect_list("copies")).alias("_each"), F.sum("copies").alias("_all")), "copies")
    hashed = plain.withColumn("_hash", F.xxhash64(body))
    joined = hashed.join(counts, hashed[key].eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("text_hash")))
    once = joined.filter(F.size("_each") == 1).select(*own, F.col("_all").alias("_copies"))
    again = joined.filter(F.size("_each") > 1).dropDuplicates([key, "_hash"]).select(*own, F.col("_all").alias("_copies"))
    copied = once.union(again).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return copied.select(*own).toDF(*docs.columns)
