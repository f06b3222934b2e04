from hypothesis import given, settings
from hypothesis import strategies as st

from barframe.llm import edits as ed
from barframe.llm import tokenfile as tf
from barframe.llm import words as wd
from barframe.llm.queries import tokenizer

import numpy as np
import pyarrow as pa

PIECES = ["a", "don't", "x.", " ", "  ", "\n", "é", "é", "漢字", "<", "|", "word", "12,"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


@settings(max_examples=250, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 60), st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), TEXT)), max_size=5), st.integers(1, 4))
def test_trees_follow_edits(text, raw, leaf):
    own = tf.encoder(tokenizer())
    data, offsets = wd.buffers(pa.array([text], pa.string()))
    chars, tokens = next(ed._leaves(own, data, offsets, leaf)) if len(offsets) > 1 else (np.zeros(1), np.zeros(1))
    tree = ed.Tree(ed.heap(chars), ed.heap(tokens))
    count = lambda t: len(own.tokenizer.encode(t, add_special_tokens=False).ids)
    assert (tree.chars[1], tree.tokens[1]) == (len(text), count(text))
    edits = ed.clean_edits([{"start": a, "length": b, "insert": c} for a, b, c in raw], len(text))
    new = ed.edited(text, edits)
    again = ed.recount(own, text, tree, edits)
    assert (tree.chars[1], tree.tokens[1]) == (len(new), count(new)) and again <= len(new)
    for i in range(1, tree.width):
        assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1] and tree.chars[i] == tree.chars[2 * i] + tree.chars[2 * i + 1]


def test_only_the_neighbourhood_is_encoded_again():
    own = tf.encoder(tokenizer())
    text = " ".join(f"word{i}" for i in range(4000))
    data, offsets = wd.buffers(pa.array([text]))
    tree = ed.Tree(*map(ed.heap, next(ed._leaves(own, data, offsets, 32))))
    assert ed.recount(own, text, tree, ed.clean_edits([{"start": 9000, "length": 30, "insert": "new"}], len(text))) < 600


def test_special_marks_made_or_broken_by_edits():
    own = tf.encoder(tokenizer())
    words = " ".join(f"w{i}" for i in range(300))
    cases = [(f"{words} <x|endoftext|> {words}", "x|", "|"), (f"{words} <|endoftext|> {words}", "<|end", "<|ed"), (f"{words} <|endoftext|> {words}", "|endoftext|", "")]
    for text, old, new in cases:
        data, offsets = wd.buffers(pa.array([text]))
        tree = ed.Tree(*map(ed.heap, next(ed._leaves(own, data, offsets, 8))))
        ed.recount(own, text, tree, ed.clean_edits([{"start": text.index(old), "length": len(old), "insert": new}], len(text)))
        after = text.replace(old, new, 1)
        assert (tree.chars[1], tree.tokens[1]) == (len(after), len(own.tokenizer.encode(after, add_special_tokens=False).ids))


def test_frames(spark, odd, empty):
    edits = spark.createDataFrame([(1, 0, 5, "Omega!"), (1, 2, 9, "skipped"), (5, 100, 40, None), (6, None, 3, "x"), (77, 0, 1, "x"), (None, 0, 1, "x"), (3, 4, 4, "new text")],
                                  "doc_id long, start long, length long, insert string")
    state = ed.count_tokens(odd, tokenizer())
    got = ed.apply_edits(odd, state, edits, tokenizer()).collect()
    own = tf.encoder(tokenizer())
    count = lambda t: len(own.tokenizer.encode(t, add_special_tokens=False).ids)
    todo = {1: [(0, 5, "Omega!")], 5: [(100, 140, "")], 3: [(0, 0, "new text")]}
    want = sorted((str(r.doc_id), count(r.text or ""), len(todo.get(r.doc_id, ())), count(ed.edited(r.text or "", todo.get(r.doc_id, [])))) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_before, r.n_edits, r.n_after) for r in got) == want
    assert ed.apply_edits(empty, ed.count_tokens(empty, tokenizer()), edits, tokenizer()).count() == 0
    scrubbed = {(r.start, r.insert) for r in ed.scrub_edits(spark.createDataFrame([(1, "mail a.b@c.org or 0123456789abcdef, +49 30 1234567")], "doc_id long, text string")).collect()}
    assert scrubbed == {(5, "<email>"), (18, "<key>"), (36, "<number>")}
