import random
import zlib

import numpy as np
import pytest

from barframe.llm import toxicity as tx

BAD = [stem + end for stem in ("scumm", "vilex") for end in ("a", "eur", "ing", "o", "ly", "est", "ous")]


def corpus(n, seed=5):
    rng = random.Random(seed)
    clean = [f"{a}{b}" for a in ("mon", "tel", "ver", "sal", "pir", "dun") for b in ("dar", "est", "ing", "or", "ula", "em", "ite", "ang")]
    docs, labels = [], []
    for i in range(n):
        words, bad = rng.choices(clean, k=rng.randrange(30, 90)), i % 6 == 0
        if bad:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    copied = rng.choices([f"rare{c}word" for c in "abcdefgh"], k=60)  # a copied toxic text must not make its words toxic
    for i in range(n, n + 30):
        docs.append((i, " ".join([*copied, BAD[0], BAD[8]])))
        labels.append((i, 1, 1))
    docs.append((n + 30, " ".join(copied)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, marks = corpus(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels, tx.train(docs, labels), dict(rows), {i: t for i, _, t in marks}


def test_held_out_accuracy(fitted):
    docs, labels, model, texts, toxic = fitted
    got = tx.toxicity(docs, labels, model=model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    right = sum(r.predicted == toxic[r.doc_id] for r in held)
    assert len(held) > 200 and right / len(held) > 0.98
    assert next(r for r in got if r.doc_id == 930).predicted == 0
    for r in got:
        words = [texts[r.doc_id].encode()[s.start : s.end].decode() for s in r.spans]
        if r.doc_id < 900:
            assert all(w in BAD for w in words)


def test_filter_agrees_and_labels_are_no_inputs(fitted, spark):
    docs, labels, model, texts, _ = fitted
    rejected = {r.doc_id for r in tx.toxicity(docs, labels, model=model).collect() if r.predicted}
    assert {r.doc_id for r in tx.without_toxic(docs, labels, model=model).collect()} == set(texts) - rejected
    flipped = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(encode(cast(doc_id as string), 'utf-8')), 3) = 1, 1 - toxic, toxic) as toxic")
    other = tx.train(docs, flipped)
    assert all(np.array_equal(a, b) for a, b in zip(model, other, strict=True))


def test_odd_rows(fitted, odd, empty, labels):
    _, given, model, _, _ = fitted
    got = tx.toxicity(odd, given, model=model).collect()
    assert len(got) == 8 and all(r.score is not None for r in got)
    blank = [r.score for r in got if r.doc_id in (2, 3, 4)]
    assert len(set(blank)) == 1 and blank[0] == min(r.score for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert tx.without_toxic(odd, given, model=model).columns == odd.columns
    assert tx.toxicity(empty, given, model=model).count() == 0
    for rows in ([], [(1, 1, 0)], [(1, 1, 1), (3, 0, 1)], [(1, 1, 1), (5, 1, 0)]):
        assert [r.score for r in tx.toxicity(odd, labels(rows)).collect()] == [0.0] * 8


def test_texts_that_share_a_passage_all_stay(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, " ".join([*passage, *(f"own{rng.randrange(10**6)}" for _ in range(40))])) for i in range(120)]
    near = docs[7][1].split()
    docs += [(200, docs[5][1]), (201, " ".join([*near[:-1], "edited"])), (202, docs[9][1]), (9, docs[9][1]), (203, ""), (204, None)]
    known = [(i, int(i == 202 or i % 2)) for i in {i for i, _ in docs}]
    known = [(i, t if i not in (200, 201) else 1) for i, t in known]
    got = tx._without_copies(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(known, "id long, toxic int")).collect()
    # 200 and 201 are near copies of 5 and 7 with the same label, 202 one of 9; the second row of 9 repeats the first.
    assert sorted(r.id for r in got) == [*range(120), 203, 204]


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    score, move = rng.normal(size=(1, 5)), np.array([-0.7, 0.4, 0.9])
    trans = {(0, 0): 0.0, (0, 1): move[0], (1, 0): move[1], (1, 1): move[2]}
    mass = np.zeros((5, 2))
    for path in np.ndindex(*[2] * 5):
        total = sum(score[0, t] * y for t, y in enumerate(path)) + trans[0, path[0]] + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False))
        for t, y in enumerate(path):
            mass[t, y] += np.exp(total)
    odds, _, _ = tx.marginals(score, np.ones((1, 5), dtype=bool), np.exp(move))
    assert np.allclose(odds[0], mass[:, 1] / mass[:, 0])
