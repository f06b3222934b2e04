import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barframe.llm import quality

JUNK = ("{}### {}$$$ {}***", "{}!! {}!! {}!!", "{} | {} | {}")


def texts(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 120))]
        good = rng.random() < 0.7
        if good:
            t = " ".join(words).capitalize() + "."
        else:
            shape = rng.choice(JUNK)
            t = " ".join(shape.format(*words[j : j + 3]) for j in range(0, len(words) - 2, 3))
        rows.append((i, t, int(good)))
    return rows


def out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def frames(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")


def test_statistics_of_a_text():
    text = 'One two, two!\n\nONE 22 two### "x"\nOne two, two!\n'
    x = dict(zip(quality.STATISTICS, quality.statistics(pa.array([text, None, "", " \n "]))[0], strict=True))
    assert abs(x["log_words"] - np.log(11)) < 1e-12
    size = [3, 4, 4, 3, 2, 6, 3, 3, 4, 4]
    assert abs(x["mean_word"] - np.mean(size)) < 1e-12 and abs(x["sd_word"] - np.std(size)) < 1e-9
    assert abs(x["symbols"] - 0.3) < 1e-12 and abs(x["exclamations"] - 0.2) < 1e-12 and abs(x["commas"] - 0.2) < 1e-12
    letters = sum(c.isalpha() for c in text)
    assert abs(x["capitals"] - 5 / letters) < 1e-12 and abs(x["digits"] - 2 / sum(size)) < 1e-12
    assert abs(x["other_marks"] - 0.2) < 1e-12 and abs(x["symbol_ends"] - 0.1) < 1e-12
    assert abs(x["distinct_words"] - 0.7) < 1e-12 and abs(x["top_word"] - 0.2) < 1e-12
    assert abs(x["repeated_triples"] - 2 / 8) < 1e-12
    assert abs(x["log_lines"] - np.log(4)) < 1e-12 and abs(x["repeated_lines"] - 1 / 3) < 1e-12 and abs(x["marked_line_ends"] - 2 / 3) < 1e-12
    assert not quality.statistics(pa.array([None, "", " \n "], pa.string())).any()


def test_statistics_do_not_depend_on_the_batch():
    rows = [t for _, t, _ in texts(300)] + ["word " * 700_000, None, "x"]
    whole = quality.statistics(pa.array(rows))
    single = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in rows])
    assert np.allclose(whole, single, rtol=0, atol=1e-12)


def test_traversal_equals_a_walk_by_hand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    t = quality.fit(x, y, trees=12, depth=3, bins=16)
    for row, got in zip(x, t.scores(x), strict=True):
        total = t.start
        for s, c, v in zip(t.statistic, t.threshold, t.leaf, strict=True):
            node = 0
            while node < len(s):
                node = 2 * node + (2 if row[s[node]] > c[node] else 1)
            total += v[node - len(s)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((t.scores(x) >= 0.5) == y).mean() > 0.95


def test_first_split_is_the_best_one():
    """The root's split against a search of all thresholds."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, size=(200, 3)).astype(float), (rng.random(200) < 0.4).astype(float)
    y[x[:, 1] > 5] = 1
    t = quality.fit(x, y, trees=1, depth=1, bins=64)
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE) if h[m].sum() >= quality.LEAST_CURVATURE else -np.inf
    best = max((gain(x[:, f] <= c) + gain(x[:, f] > c), -f, -c) for f in range(3) for c in np.unique(x[:, f]))
    assert (t.statistic[0, 0], t.threshold[0, 0]) == (-best[1], -best[2])


def test_held_out_rows(spark):
    rows = texts(900)
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert all(r.held_out == out(i) for i, r in got.items())
    hold = [(got[i].predicted, y) for i, _, y in rows if out(i)]
    assert np.mean([a == b for a, b in hold]) > 0.97
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.quality(docs, flipped).collect()} == {i: r.score for i, r in got.items()}
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 1}


def test_sample_is_bounded(spark):
    docs, labels = frames(spark, texts(400))
    model = quality.train(docs, labels, sample=60)
    assert model.scores(quality.statistics(pa.array([t for _, t, _ in texts(5)]))).shape == (5,)


def test_odd_rows(odd, empty, labels):
    known = labels([(1, 1, 0), (3, 0, 0), (5, 0, None), (6, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, None), (99, 1, 1), (4, 7, 0)])
    rows = quality.quality(odd, known).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert quality.quality(empty, known).count() == 0 and quality.keep_good(empty, known).columns == empty.columns
    assert {r.score for r in quality.quality(odd, labels([])).collect()} == {0.5}
    assert {r.predicted for r in quality.quality(odd, labels([(i, 1, 0) for i in range(7)])).collect()} == {1}
