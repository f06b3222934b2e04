import random

from barframe.llm import lines as ln


def brute(docs, min_words):
    """The stated rule, by loops: windows with an earlier equal window are extended beside its first place and deleted."""
    def full(t):
        return [(i, x) for i, x in enumerate((t or "").split("\n")) if x.split()]

    order = sorted({(i is not None, i, t) for i, t in docs if t is not None}, key=lambda d: (d[0], d[1] or 0, hash_of[d[2]]))
    seqs = [[x for _, x in full(t)] for _, _, t in order]
    firsts, gone = {}, [set() for _ in order]
    for d, s in enumerate(seqs):
        for i in range(len(s)):
            e, n = i, 0
            while e < len(s) and n < min_words:
                n += len(s[e].split())
                e += 1
            if n < min_words:
                continue
            d0, i0 = firsts.setdefault(tuple(s[i:e]), (d, i))
            if (d0, i0) != (d, i):
                lo = hi = 0
                while i - lo > 0 and i0 - lo > 0 and s[i - lo - 1] == seqs[d0][i0 - lo - 1]:
                    lo += 1
                while i + hi < len(s) and i0 + hi < len(seqs[d0]) and s[i + hi] == seqs[d0][i0 + hi]:
                    hi += 1
                gone[d] |= set(range(i - lo, i + hi))
    out = {}
    for (_, i, t), g in zip(order, gone, strict=True):
        drop = {full(t)[j][0] for j in g}
        out[i, t] = (len(full(t)), len(drop), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop))
    return out


hash_of: dict = {}


def test_against_brute_force(spark):
    rng = random.Random(6)
    pool = [f"line {i} " + "w " * (i % 7) for i in range(25)] + ["", "  "]
    passage = rng.choices(pool, k=6)
    docs = []
    for i in range(60):
        own = rng.choices(pool, k=rng.randrange(0, 14)) if i % 3 else [f"unique {i} {j} words" for j in range(8)]
        if i % 2:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
        docs.append((i, "\n".join(own)))
    docs += [(10, docs[10][1]), (10, docs[13][1]), (None, docs[1][1]), (70, None), (71, ""), (72, ("same line of words\n" * 30).strip())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hash_of.update({r.text: r.h for r in df.selectExpr("text", "xxhash64(text) as h").collect()})
    want = brute(docs, 12)
    got = ln.without_repeats(df, min_words=12).collect()
    assert len(got) == len(docs) and sum(r.n_removed > 0 for r in got) > 20
    found = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got), key=str)
    assert found == sorted(((i, *want[i, t]) if t is not None else (i, 0, 0, None) for i, t in docs), key=str)


def test_every_deleted_line_stays_somewhere(spark):
    docs = [(i, "\n".join(["shared line one of the passage here", f"own {i}", "shared a b c d e f", "shared g h i j k l"])) for i in range(20)]
    got = ln.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), min_words=12).collect()
    left = "\n".join(r.text for r in sorted(got, key=lambda r: r.doc_id)).split("\n")
    assert {x for _, t in docs for x in t.split("\n")} == set(left)
    assert left.count("shared a b c d e f") == 1 and left.count("shared line one of the passage here") == 20


def test_odd_rows(odd, empty):
    got = ln.without_repeats(odd).collect()
    assert len(got) == 8 and all(r.n_removed == 0 for r in got) and sum(r.text is None for r in got) == 1
    assert ln.without_repeats(empty).count() == 0
