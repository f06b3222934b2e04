import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from barframe.llm import words as wd

TEXT = st.text(st.sampled_from("aAbZz09 \n\t\r.,-_éß漢\x00\x7f|'<"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.booleans(), st.integers(1, 40))
def test_words_equal_the_patterns(texts, plain, piece):
    old, wd.PIECE = wd.PIECE, piece
    try:
        low = str.maketrans(wd.UPPER, wd.LOWER)
        want = [re.findall(wd.PLAIN if plain else wd.SPACED, (t or "").translate(low)) for t in texts]
        got = []
        for lo, hi, w in wd.batch_words(pa.array(texts, pa.string()), plain, True, limit=30):
            got += [[w.text(i).decode() for i in range(w.first[r], w.first[r + 1])] for r in range(hi - lo)]
            for i in range(len(w.hash)):
                for j in range(i):
                    assert (w.hash[i] == w.hash[j]) == (w.text(i) == w.text(j))
        assert got == want
    finally:
        wd.PIECE = old


def test_hash_does_not_depend_on_the_place():
    w = next(wd.batch_words(pa.array(["one two", "x" * 50 + " two one two"]), True, True))[2]
    assert w.hash[1] == w.hash[3] == w.hash[5] and w.hash[0] == w.hash[4]
    grams, at = w.grams(2)
    assert list(at) == [0, 2, 3, 4] and grams[0] == grams[3]


def test_prefix_hashes():
    w = next(wd.batch_words(pa.array(["banana band ban"]), True, True, prefixes=(3,)))[2]
    assert len(set(w.prefix[0])) == 1 and len(set(w.hash)) == 3


def test_runs():
    assert list(wd.runs(np.array([2, 0, 3]))) == [0, 1, 0, 1, 2]


def test_a_task_drops_the_tokenizer_before_it_and_gives_memory_back(monkeypatch):
    """Stages share workers: a task of another operator starts without the kept tokenizer, and its end gives freed memory back."""
    ended = []
    monkeypatch.setattr(wd, "give_back", lambda: ended.append(True))
    wd.worker_store().update(encoder="kept", encoder_key="key")
    assert list(wd.lean(lambda batches: (b + 1 for b in batches), drop=())(iter([1, 2]))) == [2, 3]
    assert wd.worker_store()["encoder"] == "kept" and len(ended) == 1
    assert list(wd.lean(lambda batches: (("encoder" in wd.worker_store(), b) for b in batches))(iter([5]))) == [(False, 5)]
    assert "encoder_key" not in wd.worker_store() and len(ended) == 2
