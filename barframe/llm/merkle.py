"""Merkle manifest of a dataset, with inclusion proofs by pointer jumping.

Every row is a leaf: the sha256 of its fields, each as UTF-8 byte count, ``:`` and value, or ``-`` for a null. The leaves of a
source, in order of id, form a tree in which ``FANOUT`` consecutive nodes have one parent, the sha256 of their hex digests; the
roots of the sources, null source first, then by UTF-8 bytes, form the top tree. So a source can be checked alone.

A node is (tree, level, place). Levels are built bottom-up by grouping a place's quotient: at most ``FANOUT`` rows a group, whatever
a source's share of the rows. Each node then holds the siblings on its way to its parent, a segment of length one.
A round joins the nodes with themselves: a node takes over its ancestor's segment and ancestor, so the distance doubles, and
the number of rounds is the logarithm of the depth. Leaves of one run share every ancestor, so they jump as one row (the run) and
are unfolded at the end, when the run's path has reached the root; a leaf's own siblings come from the run.

Places inside a source are counted in range partitions of (source, id, leaf), written first, plus the counts of earlier parts: no
window holds a source. The right side of a round has one row per node and holds only nodes that can be the
ancestor at that distance, so it shrinks by the fan-out's power; the join is broadcast below Spark's threshold, else shuffled and
split by adaptive execution.

Defined cases: null ids come first in their source, equal ids follow by leaf digest; repeated rows are leaves of their own; an empty text
is ``0:``; an empty table has no leaves and no root (``root`` is None); a lone leaf is its source's root, and the root if it is
the only one. Extra columns are not part of a leaf unless they are named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.plans.settle import release, settle

FANOUT = 16
PART_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = -1


def field(value: str | Column) -> Column:
    """A value as its UTF-8 byte count, ``:`` and itself; ``-`` for a null."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: str | Column) -> Column:
    """The leaf digest of a row's fields."""
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, leaf level first, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _levels(nodes: int, fanout: int) -> int:
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // fanout), n + 1
    return n


def _placed(df: DataFrame, key: str, order: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their part, parts): a row's place in its key is ``before`` of its part plus its rank inside the part."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, key, *order, "_tie")
    d = settle(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"))
    return d, settle(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "parts")


def _places(d: DataFrame, parts: DataFrame, key: str, order: list[str]) -> DataFrame:
    inside = Window.partitionBy("_part", key).orderBy(*order, "_tie")
    at = d.withColumn("_at", F.row_number().over(inside) - 1).join(parts.drop("_n"), ["_part", key])
    return at.withColumn("place", (F.col("_before") + F.col("_at")).cast("long")).drop("_before", "_at", "_part", "_tie")


def _node(tree, level, place) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), place.cast("long").alias("place"))


def _step(body: Column, i: Column) -> Column:
    """Siblings left and right of child ``i`` in a run's digests."""
    return F.struct(F.substring(body, F.lit(1), i * 64).alias("left"), F.substring(body, i * 64 + 65, F.length(body)).alias("right"))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: id, source, carried columns, leaf, tree, place, path (array of left and right sibling digests, leaf level first).

    ``sources``: source, tree (its rank), size, subroot. ``root``: hex digest, None for an empty table.
    """

    leaves: DataFrame
    sources: DataFrame
    root: str | None
    settled: tuple[DataFrame, ...]

    def release(self) -> None:
        release(*self.settled, sweep=False)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, *, id: str = "doc_id", source: str = "source", fanout: int = FANOUT,
             carry: dict[str, Column] | None = None, part_rows: int = PART_ROWS) -> Manifest:
    """The manifest of ``docs``; ``carry`` names further columns (over ``docs``) that come along with the leaves."""
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit("x"), F.col(source).cast("string")), F.lit(""))
    # One pass over the texts; everything later moves digests only.
    hashed = settle(docs.select(F.col(id).alias("id"), key.alias("_key"), digest(*fields).alias("leaf"),
                                F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("carried")), "leaves")
    ranged, parts = _placed(hashed, "_key", ["id", "leaf"], part_rows)
    release(hashed, sweep=False)
    sizes = settle(parts.groupBy("_key").agg(F.sum("_n").alias("size")), "sizes")
    s_ranged, s_parts = _placed(sizes.withColumn("_all", F.lit(0)), "_all", ["_key"], part_rows)
    sources = settle(_places(s_ranged, s_parts, "_all", ["_key"]).select("_key", F.col("place").alias("tree"), "size"), "sources")
    n_sources, largest = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()

    placed = _places(ranged, settle(parts.join(sources, "_key"), "parts"), "_key", ["id", "leaf"])
    run = F.expr(f"place div {fanout}")
    kid = F.struct("place", F.col("leaf").alias("hash"), "id", "carried")
    runs = settle(placed.groupBy("tree", run.alias("run")).agg(F.max("size").alias("count"), F.sort_array(F.collect_list(kid)).alias("kids")), "runs")
    release(ranged, parts, sizes, s_ranged, s_parts, sweep=False)

    def parent(level):
        """A run's parent; the only node of a level is the root of its source, a leaf of the top tree."""
        alone = F.col("count") <= fanout
        return F.when(F.col("tree") == _TOP, _node(F.col("tree"), F.lit(level + 1), F.col("run"))).otherwise(
            F.when(alone, _node(F.lit(_TOP), F.lit(0), F.col("tree"))).otherwise(_node(F.col("tree"), F.lit(level + 1), F.col("run"))))

    body = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
    own = settle(runs.select("tree", "run", "count", parent(0).alias("anc"), F.when(F.col("count") == 1, F.element_at("kids", 1)["hash"]).otherwise(F.sha2(body, 256)).alias("hash")), "parents")
    step = F.posexplode(F.transform("kids", lambda k: F.struct(k["place"].alias("place"))))
    tables, inner, roots = [own], [], []

    def climb(nodes: DataFrame, levels: int, first: int):
        """Levels above ``nodes`` (tree, place, count, hash); their rows with the segments to their parents go to ``inner``."""
        for level in range(first, first + levels):
            up = nodes.groupBy("tree", run.alias("run")).agg(F.max("count").alias("count"), F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("kids"))
            up = settle(up, "level")
            tables.append(up)
            inner.append(up.select("tree", "run", body.alias("body"), parent(level).alias("anc"), step.alias("i", "k"))
                         .select(_node(F.col("tree"), F.lit(level), F.col("k.place")).alias("node"), F.array(_step(F.col("body"), F.col("i"))).alias("path"), "anc"))
            nodes = up.select("tree", F.col("run").alias("place"), F.expr(f"(count + {fanout - 1}) div {fanout}").alias("count"), F.sha2(body, 256).alias("hash"))
            roots.append(nodes.filter("count = 1"))
            nodes = nodes.filter("count > 1")

    first = own.select("tree", F.col("run").alias("place"), F.expr(f"(count + {fanout - 1}) div {fanout}").alias("count"), "hash")
    roots.append(first.filter("count = 1"))
    climb(first.filter("count > 1"), max(_levels(largest, fanout) - 1, 0), 1)
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.union(r)
    subroots = settle(subroots.select("tree", F.col("hash").alias("subroot")), "subroots")
    roots.clear()
    top = _levels(n_sources, fanout)
    climb(subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_sources).cast("long").alias("count"), F.col("subroot").alias("hash")), top, 0)
    last = (roots[-1].select("hash") if top else subroots.select("subroot")).first()

    # Distances double: after round r a path covers 2^(r+1) levels.
    empty = F.expr("cast(array() as array<struct<left:string,right:string>>)")
    paths = own.select("tree", "run", "anc").withColumn("path", empty)
    if inner:
        nodes = inner[0]
        for n in inner[1:]:
            nodes = nodes.union(n)
        nodes = settle(nodes, "nodes")
        rounds = (_levels(largest, fanout) + top + 1).bit_length()
        for r in range(rounds):
            ahead = nodes.filter((F.col("node.tree") == _TOP) | (F.col("node.level") >= 2**r))
            ahead = ahead.select(F.col("node").alias("anc"), F.col("path").alias("_more"), F.col("anc").alias("_next"))
            jump = lambda t: t.join(ahead, "anc", "left").withColumns({"path": F.concat("path", F.coalesce("_more", empty)), "anc": F.coalesce("_next", "anc")}).drop("_more", "_next")  # noqa: B023, E731
            before, paths = paths, settle(jump(paths), "paths")
            release(*([before] if r else []), sweep=False)
            if r + 1 < rounds:
                before, nodes = nodes, settle(jump(nodes), "nodes")
                release(before, sweep=False)
        release(nodes, sweep=False)
        tables.append(paths)
    sources = settle(sources.join(subroots, "tree"), "sources")
    release(*tables[1:-1] if inner else [], sweep=False)

    d = runs.join(paths.select("tree", "run", "path"), ["tree", "run"]).withColumn("body", body)
    d = d.select("tree", "count", "path", "body", F.posexplode("kids").alias("i", "k"))
    path = F.when(F.col("count") == 1, F.col("path")).otherwise(F.concat(F.array(_step(F.col("body"), F.col("i"))), "path"))
    d = d.select("tree", "k.*", path.alias("path")).join(sources.select("tree", "_key", "subroot"), "tree")
    name = lambda k: F.when(F.col(k) != "", F.expr(f"substring({k}, 2)"))
    leaves = d.select(F.col("id").alias(id), *([name("_key").alias(source)] if source != id else []), *[F.col(f"carried.{n}") for n in carry],
                      F.col("hash").alias("leaf"), "tree", "place", "path", "subroot")
    return Manifest(leaves, sources.select(name("_key").alias(source), "tree", "size", "subroot"), last[0] if last else None, (runs, own, sources, *([paths] if inner else [])))
