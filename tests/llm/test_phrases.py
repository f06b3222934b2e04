import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from barframe.llm import phrases
from barframe.llm import words as wd

SCHEMA = "doc_id long, text string, lang string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, longest=4, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        cand = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            s, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df, **more):
    cols = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in cols) for r in phrases.collocations(df, **more).collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünï", "New", "York", "İx", "a-b"]
    rows = []
    for i in range(160):
        words = [rng.choice(vocabulary[: 5 + i % 12]) for _ in range(rng.randrange(0, 60))]
        words = [w + rng.choice(["", "", "", "", ".", ",", "\n", "\t", "!?", " New York City Hall", "\r"]) for w in words]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(words)))
    return rows + [(None, None), ("en", ""), ("fr", " ,.\n"), *[("en", "new york city hall")] * 40]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("least", [3, 30])
def test_against_counting_all(spark, texts, least):
    want = plain(texts, least)
    assert len(want) > 2 and found(frame(spark, texts), least=least) == want


def test_small_blocks_and_full_bit_table(spark, texts):
    assert found(frame(spark, texts), least=5, block=7, max_bits=1 << 15) == plain(texts, 5)


@pytest.mark.parametrize("bits", [3, 9])
def test_collisions_are_settled_by_text(spark, texts, bits):
    assert found(frame(spark, texts), least=5, fp_bits=bits) == plain(texts, 5)


def test_top_and_ties(spark, texts):
    assert found(frame(spark, texts), least=4, top=5) == plain(texts, 4, top=5)


def test_odd_rows_and_none(odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert found(odd, least=2) == plain(rows, 2)
    assert found(empty) == []


def test_fingerprints_depend_on_words_only():
    lines = pa.array(["xx alpha beta gamma", "alpha beta gamma yy, alpha  beta\tgamma"])
    (_, _, w), = phrases.cut(lines)
    g = phrases.Grams(w, phrases.seeds(pa.array(["en", "en"])))
    for which in (0, 1):
        h = g.of(g.places(3), 3, which).tolist()
        assert len(h) == 5 and h[1] == h[2] == h[4] and len(set(h)) == 3


def test_counts_leave_a_task_in_small_batches():
    """A block of counts goes to the executor in parts, and all of it."""

    class Task:  # runs a stage's function on one batch
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    n = 3 * wd.ROWS + 7
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([1], pa.int64()), pa.array([" ".join(f"w{i}" for i in range(n)) + " w0"])], names=["lang", "key", "text"])
    parts = list(phrases._scan(Task(), (1,), None, 64, phrases.BLOCK)(iter([batch])))
    assert max(p.num_rows for p in parts) <= wd.ROWS
    assert sum(p.num_rows for p in parts) == len({v for p in parts for v in p.column("fp").to_pylist()}) == n
    assert sum(sum(p.column("n").to_pylist()) for p in parts) == n + 1
