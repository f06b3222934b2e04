import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barframe.llm import tokenfile as tf
from barframe.llm.queries import tokenizer

PIECES = ["a", "Z", "don't", "'s", "''", "it'LL", " ", "\n", "\t", "  ", ".", ",", "...", "…", "é", "é", "́", "漢", "9", "12", "-", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", "İ", "ß", "\xa0", " ", "😀", "_", "KK", "Σ", "ΑΣ"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=6))
def test_chunks_equal_whole_texts(texts):
    own = tf.encoder(tokenizer())
    got = []
    for _, ids, counts in own.encode(pa.array([*texts, None], pa.string())):
        got += [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [*(e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)), []]


def test_a_small_cache_begins_anew(monkeypatch, whole):
    monkeypatch.setattr(tf, "CACHED", 5)
    own = tf.ChunkEncoder(tokenizer())
    for text in ("one two three four", "three four five six seven", "one seven eight nine ten eleven", "six"):
        _, ids, _ = next(own.encode(pa.array([text])))
        assert list(ids) == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 30), max_size=6), st.integers(1, 9), st.randoms(use_true_random=False))
def test_segments_round_trip(bits, sizes, block, rng):
    docs = [np.array([rng.randrange(1 << bits) for _ in range(n)], dtype=np.uint32) for n in sizes]
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    held = tf.Segment(tf.write_segment(ids, np.cumsum(sizes), bits, block))
    assert list(held.ids(0, held.count)) == list(ids)
    assert [list(held.document(i)) for i in range(held.docs)] == [list(d) for d in docs]
    if len(ids):
        a = rng.randrange(len(ids))
        assert held.ids(a, a + 1)[0] == ids[a]


def test_width():
    assert [tf.width(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_files_against_whole_texts(spark, odd, empty, whole, tmp_path):
    rows = [(i % 40, f"Document number {i}, it's <|endoftext|> here" if i % 7 == 0 else f"word{i} again, and again.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    path = str(tmp_path / "tokens")
    tf.write_tokens(docs, path, tokenizer(), segment=50, block=16)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tf.read_tokens(spark, path).collect())
    assert [r[1] for r in got if r[1] is not None] == sorted(r[1] for r in got if r[1] is not None) and got[-1][1] is None
    at, want = 0, {}
    for r in docs.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.setdefault((r.doc_id, len(ids), zlib.crc32(ids.tobytes())), []).append(r)
    for start, doc, n, crc in got:
        assert start == at
        want[doc, n, crc].pop()
        at += n
    assert not any(want.values())
    tf.write_tokens(empty, path + "0", tokenizer())
    assert tf.read_tokens(spark, path + "0").count() == 0
