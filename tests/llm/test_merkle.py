import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barframe.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[c] for c in FIELDS)))


def tree(level, fanout):
    """The root of a list of digests and the siblings of each, level by level, left to right."""
    path, members = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        above, owners = [], []
        for lo in range(0, len(level), fanout):
            run = level[lo : lo + fanout]
            for j in range(len(run)):
                for i in members[lo + j]:
                    path[i].append((run[:j], run[j + 1 :]))
            above.append(h("".join(run)))
            owners.append([i for m in members[lo : lo + fanout] for i in m])
        level, members = above, owners
    return level[0], path


def plain(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"], leaf(r)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        below[s] = tree([x for _, x in by[s]], fanout)
    root, top = tree([below[s][0] for s in sources], fanout)
    out = []
    for s, up in zip(sources, top, strict=True):
        for (i, digest), path in zip(by[s], below[s][1], strict=True):
            out.append((i, s, digest, below[s][0], tuple(("".join(a), "".join(b)) for a, b in path + up)))
    return root, out


def order(x):
    return tuple((v is not None, str(v)) for v in x)


def check(docs, fanout, part_rows=merkle.PART_ROWS):
    made = merkle.manifest(docs, fanout=fanout, part_rows=part_rows)
    root, want = plain(docs.collect(), fanout)
    got = [(r.doc_id, r.source, r.leaf, r.subroot, tuple((s.left, s.right) for s in r.path)) for r in made.leaves.collect()]
    assert made.root == root
    assert sorted(got, key=order) == sorted(want, key=order)
    folded = made.leaves.select(merkle.fold(F.col("leaf"), F.col("path")).alias("f")).distinct().collect()
    assert [r.f for r in folded] == [root]
    made.release()


@pytest.fixture(scope="module")
def many(spark):
    """A hot source, lone leaves, a null source and sources whose byte order is not their code point case order."""
    rows = [(i, f"text {i % 700}", "en", "hot" if i % 3 else f"s{i % 40}é" if i % 2 else f"S{i % 7}", i) for i in range(1500)]
    rows += [(5000 + i, None, None, None, None) for i in range(18)] + [(9000, "x", "de", "alone", 1), (9001, "x", "de", "", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_trees_and_proofs(many):
    check(many, 16)


def test_deep_trees_and_small_parts(many):
    check(many, 3, part_rows=200)


def test_odd_rows(odd):
    check(odd, 2)


def test_many_sources(spark):
    rows = [(i, "t", "en", f"s{i}", 1) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 4)


def test_one_leaf_and_none(odd, empty):
    check(odd.filter("doc_id = 3"), 16)
    made = merkle.manifest(empty)
    assert made.root is None and made.leaves.count() == 0 and made.sources.count() == 0


def test_tampering_shows(many):
    changed = F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text"))
    made = merkle.manifest(many, carry={"seen": merkle.digest("doc_id", "source", "lang", "n_chars", changed)})
    bad = made.leaves.filter(merkle.fold(F.col("seen"), F.col("path")) != made.root).select("doc_id").collect()
    assert [r.doc_id for r in bad] == [7]
