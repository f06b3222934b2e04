import itertools

from pyspark.sql import functions as F

from barframe.llm import mixing as mx


def test_targets():
    sizes = {"a": 100, "b": 10, None: 40}
    weights = mx.cyclic_weights(sizes)
    assert weights == {"a": 1, "b": 2, None: 3}
    got = mx.targets(sizes, weights)
    assert got == {"b": 30.0, "a": 30.0, None: 90.0} and sum(got.values()) == 150
    assert mx.targets({"a": 0}, {"a": 1}) == {"a": 0.0}
    assert mx.targets({}, {}) == {}


def cost(flow):
    return sum(2**k * n for (_, k, _), n in flow.items())


def cheapest_by_trial(supply, quota, most):
    """Least cost of filling the quotas, over all splits of small supplies."""
    patterns = list(supply)
    options = []
    for p in patterns:
        total = supply[p] * most
        options.append([c for c in itertools.product(range(total + 1), repeat=len(p)) if sum(c) <= total])
    best = None
    for choice in itertools.product(*options):
        got = dict.fromkeys(quota, 0)
        price = 0
        for p, c in zip(patterns, choice, strict=True):
            for s, n in zip(p, c, strict=True):
                got[s] += n
            left = sum(c)
            for k in range(most):
                price += 2**k * min(left, supply[p])
                left -= min(left, supply[p])
        if got == quota and (best is None or price < best):
            best = price
    return best


def test_flow_is_cheapest():
    cases = [({("a",): 1, ("a", "b"): 2, ("b",): 1}, {"a": 3, "b": 2}), ({("a", "b"): 2, ("b", "c"): 1}, {"a": 2, "b": 1, "c": 2}),
             ({("a",): 2, ("a", "b"): 1}, {"a": 1, "b": 2})]
    for supply, quota in cases:
        flow = mx.cheapest_flow(supply, quota, 3)
        for s, q in quota.items():
            assert sum(n for (_, _, t), n in flow.items() if t == s) == q
        for (p, k), n in {(p, k): sum(n for (q, j, _), n in flow.items() if (q, j) == (p, k)) for p, k, _ in flow}.items():
            assert n <= supply[p], (p, k)
        assert cost(flow) == cheapest_by_trial(supply, quota, 3)


def rows_of(spark):
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), ["big", "big", "small", None, "mid"][i % 5] if i < 900 else "big") for i in range(1500)]
    return spark.createDataFrame([*rows, (2000, None, "empty"), (2001, "", "empty")], "doc_id long, text string, source string")


def test_mix_meets_targets(spark):
    old, mx.RANGE_ROWS = mx.RANGE_ROWS, 64
    try:
        docs = rows_of(spark)
        got = mx.mix(docs).collect()
        again = mx.mix(docs.repartition(7)).collect()
    finally:
        mx.RANGE_ROWS = old
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert len(got) == 1502 and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in got)
    sums = {}
    for r in got:
        n, t = sums.get(r.pattern[0], (0, 0))
        sums[r.pattern[0]] = n + r.taken, r.target
    for n, target in sums.values():
        assert abs(n - target) <= 2
    assert mx.mix(docs, seed=1).filter("taken > 0").exceptAll(mx.mix(docs).filter("taken > 0")).count() > 0


def test_overlapping_sources(spark):
    rows = [(i, "a b c d", [["x"], ["x", "y"], ["y", "z"], ["z", "z"], [None]][i % 5]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mx.mix(docs).collect()
    assert len(got) == 500 and sum(r.taken for r in got) > 0 and all(r.copies <= 3 for r in got)


def plain_targets(docs, weights=None):
    sizes = {}
    for r in docs:
        for s in set(r[2]):
            sizes[s] = sizes.get(s, 0) + len((r[1] or "").split())
    return sizes, mx.targets(sizes, weights or mx.cyclic_weights(sizes))


def test_targets_of_tables_equal_the_plain_rule(spark):
    rows = [(i, "w " * (i * i % 23), [[f"s{i % 7}"], [f"s{i % 3}", "é"], [None], ["z"] if i == 3 else ["s1"], [f"u{i % 11}"]][i % 5]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    for weights in (None, {s: 1 + i % 5 for i, s in enumerate(sorted({s for r in rows for s in r[2]}, key=str))}):
        sizes, aim = plain_targets(rows, weights)
        got = mx.mix(docs, weights=weights).collect()
        assert len(got) == 400
        for r in got:
            assert abs(r.target - sum(aim[s] for s in r.pattern)) < 1e-6 and r.source_size == sum(sizes[s] for s in r.pattern) and r.copies <= 3
        # What the sources get in all is what the flow fills, but for the last documents.
        supply = {}
        for r in got:
            supply[tuple(r.pattern)] = supply.get(tuple(r.pattern), 0) + r.size
        flow = mx.cheapest_flow(supply, {s: round(t) for s, t in aim.items()}, 3)
        assert abs(sum(r.taken for r in got) - sum(flow.values())) <= 30 * len(supply)


def test_sources_without_overlap_have_no_cap(spark):
    old, mx.MAX_PATTERNS = mx.MAX_PATTERNS, 100
    try:
        rows = [(i, "w " * (i % 9 + 1), [f"source{i:05d}"]) for i in range(6_000)]
        docs = spark.createDataFrame([*rows, (6_000, "w w", ["x", "y"]), (6_001, "w", ["x"])], "doc_id long, text string, source array<string>")
        got = mx.mix(docs).collect()
    finally:
        mx.MAX_PATTERNS = old
    sizes, aim = plain_targets([(r.doc_id, "w " * r.size, r.pattern) for r in got])
    assert len(got) == 6_002 and all(abs(r.target - sum(aim[s] for s in r.pattern)) < 1e-6 for r in got)
    # A source of one text takes it as often as comes nearest to its target.
    assert all(abs(r.taken - r.target) <= r.size for r in got if len(r.pattern) == 1 and r.doc_id < 6_000)


def test_mixed_rows(spark, odd, empty):
    docs = rows_of(spark)
    counts = {r.doc_id: r["count"] for r in mx.mixed(docs).groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in mx.mix(docs).filter("taken > 0").collect()}
    got = mx.mix(odd).collect()
    assert len(got) == 8 and sum(r.size == 0 and r.taken == 0 for r in got) == 3
    kept = mx.mixed(odd)
    assert kept.columns == odd.columns and kept.filter(F.col("text").isNull()).count() == 0
    assert kept.agg(F.sum(mx.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert mx.mix(empty).count() == 0 and mx.mixed(empty).count() == 0
