import random
import re

from barframe.llm import benchmarks as bm
from barframe.llm import words as wd

LOW = str.maketrans(wd.UPPER, wd.LOWER)


def split(t):
    return re.findall(wd.PLAIN, (t or "").translate(LOW))


def brute(docs, items, n):
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, it in items:
            v = split(it)
            k = min(n, len(v))
            if item is None or not k:
                continue
            own = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in own:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(80)] + [(80, None), (80, ""), (81, "W1, w2.W3")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9)))) for i in range(25)] + [(7, "w1 w2 w3"), (None, "w1 w2"), (30, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 200):
        got = [(r.doc_id, r.n_words, r.n, tuple(r["items"])) for r in bm.benchmark_hits(d, b, n=4, block_bytes=block).withColumn("n", bm.hit_words("spans")).collect()]
        assert sorted(got, key=str) == brute(docs, items, 4)
        clean = sorted((r.doc_id, r.text or "") for r in bm.without_benchmark(d, b, n=4, block_bytes=block).collect())
        keep = [(i, t or "") for i, t in docs if brute([(i, t)], items, 4)[0][2] == 0]
        assert clean == sorted(keep)


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "beta gamma delta"), (2, "漢字 ok line")], "item_id long, text string")
    got = bm.benchmark_hits(odd, items).collect()
    assert len(got) == 8 and sorted(len(r["items"]) for r in got) == [0, 0, 0, 0, 1, 1, 1, 1]
    kept = bm.without_benchmark(odd, items)
    assert kept.columns == odd.columns and kept.count() == 4
    assert bm.benchmark_hits(empty, items).count() == 0
    assert bm.without_benchmark(odd, items.limit(0)).count() == 8
