import random
import re

import numpy as np

from barframe.llm import jaccard as jc
from barframe.llm import words as wd
from barframe.llm.components import components, contract

LOW = str.maketrans(wd.UPPER, wd.LOWER)


def shingles(t, k):
    w = re.findall(wd.SPACED, (t or "").translate(LOW))
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(sets[a]), least.get(find(a))) for a, (i, _) in enumerate(docs)), key=str)


def corpus(rng):
    """Groups of copies with mutual similarities around the bound, a passage in many texts, and texts of few words."""
    vocabulary = [f"v{i}" for i in range(400)]
    docs = []
    passage = rng.choices(vocabulary, k=30)
    for size, edits in ((60, 4), (25, 2), (10, 1), (8, 8)):
        base = rng.choices(vocabulary, k=90)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[at], "new"]])
            docs.append(w)
    docs += [passage + rng.choices(vocabulary, k=rng.randrange(0, 12)) for _ in range(25)]
    docs += [rng.choices(vocabulary, k=rng.randrange(0, 8)) for _ in range(25)]
    docs += [["a", "a", "a", "a", "a", "a"][: rng.randrange(1, 7)] for _ in range(6)]
    rng.shuffle(docs)
    return [(i * 3, " ".join(w)) for i, w in enumerate(docs)]


def test_components_against_brute_force(spark):
    for seed, chunk in ((1, 1024), (2, 16)):
        docs = corpus(random.Random(seed))
        docs += [docs[5], (docs[7][0], "other words under this id"), (999, None), (998, " "), (None, docs[3][1])]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        found = jc._grouped(df, "doc_id", "text", 4, 85, chunk=chunk)
        assert sorted(((r.id, r.n, r.component_id) for r in found.collect()), key=str) == brute(docs, 4, 85)


def test_one_of_each(spark):
    docs = corpus(random.Random(4)) + [(5000, None), (5001, ""), (5002, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r.doc_id for r in jc.one_of_each(df).collect())
    assert kept == sorted({c for _, _, c in brute(docs, 4, 85)})


def test_unlinked_texts_under_one_id_or_none_stay(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(20)) for c in "abcdefg"}
    docs = [(None, text["a"]), (None, text["b"]), (None, text["c"]), (None, text["c"]), (7, text["d"]), (7, text["e"]), (8, text["f"]), (None, text["f"]), (9, text["f"] + " x"), (9, text["g"])]
    kept = jc.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = [(None, text["a"]), (None, text["b"]), (None, text["c"]), (7, text["d"]), (7, text["e"]), (8, text["f"]), (9, text["g"])]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_odd_rows(odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jc.jaccard_components(odd).collect()), key=str)
    assert got[:2] == [(1, 2, 1), (1, 2, 1)] and (None, 2, 1) in got and (2, 0, 2) in got and (4, 0, 4) in got and (5, 977, 5) in got
    kept = jc.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6]
    assert jc.jaccard_components(empty).count() == 0 and jc.one_of_each(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2)]
    for block in (1 << 15, 7):
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), block).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_contract_against_plain_search():
    rng = np.random.default_rng(3)
    for n, m in ((5, 3), (200, 150), (200, 260), (1000, 400)):
        a, b = rng.integers(-n, n, m), rng.integers(-n, n, m)
        near = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
        want = {}
        for x in sorted(near):
            todo = [x] if x not in want else []
            while todo:
                y = todo.pop()
                if y not in want:
                    want[y] = x
                    todo += near[y]
        ids, root = contract(a, b)
        assert dict(zip(ids.tolist(), root.tolist(), strict=True)) == want
