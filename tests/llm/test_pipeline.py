import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from barframe.llm import toxicity as tx
from barframe.llm import words as wd
from barframe.llm.queries import ORACLES, QUERIES, tokenizer
from tests.llm.test_benchmarks import brute as leaks
from tests.llm.test_jaccard import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage keeps, one after the other."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((docs.columns, docs.collect()))
    return spark.read.parquet(f"{SF}/documents.parquet"), out


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_binary_output"]
    assert set(ORACLES) <= set(QUERIES) and {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


def test_stages_against_plain_code(spark, stages):
    docs, out = stages
    before = docs.collect()
    assert all(columns == docs.columns for columns, _ in out[:4])
    bad = {r.doc_id for r in tx.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert sorted(r.doc_id for r in out[0][1]) == sorted(r.doc_id for r in before if r.doc_id not in bad)
    kept = [(r.doc_id, r.text) for r in out[0][1]]
    assert sorted(r.doc_id for r in out[1][1]) == sorted({c for _, _, c in groups(kept, 4, 85)})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(r.doc_id, r.text) for r in out[1][1]]
    assert sorted(r.doc_id for r in out[2][1]) == sorted(i for i, _, n, _ in leaks(kept, items, 10) if not n)
    sizes = Counter()
    for r in out[2][1]:
        sizes[r.source] += len(re.findall(wd.SPACED, r.text or ""))
    copies = Counter(r.doc_id for r in out[3][1])
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in out[2][1]}
    taken = Counter()
    for r in out[3][1]:
        taken[r.source] += len(re.findall(wd.SPACED, r.text))
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    free, left, aim = set(sizes), sum(sizes.values()), {}
    while free:
        whole = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / whole > 3 * sizes[s]}
        for s in over or free:
            aim[s] = 3 * sizes[s] if over else left * weights[s] / whole
        left -= sum(aim[s] for s in over)
        free = free - over if over else set()
    words = {}
    for r in out[2][1]:
        words.setdefault(r.source, []).append(len(re.findall(wd.SPACED, r.text or "")))
    for s, n in words.items():  # few documents a source here: as near as whole documents come
        rest = round(aim[s]) % sizes[s] if sizes[s] else 0
        sums = {0}
        for x in n:
            sums |= {y + x for y in sums}
        assert abs(taken[s] - aim[s]) <= min(abs(y - rest) for y in sums) + 1


def test_token_rows(stages):
    from tokenizers import Tokenizer

    _, out = stages
    tok, at = Tokenizer.from_file(tokenizer()), 0
    got = sorted(out[4][1], key=lambda r: r.start)
    texts = {r.doc_id: r.text for r in out[3][1]}
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in out[3][1])
    for r in got:
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_gives_the_stages_rows(spark, stages):
    assert sorted(cp.run(spark, SF).collect()) == sorted(stages[1][4][1])


def test_odd_documents(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in cp.STAGES[:4]:
            kept = stage(spark, docs, SF)
            assert kept.columns == docs.columns
            if docs is empty:
                assert kept.count() == 0
        assert cp.STAGES[4][1](spark, docs, SF).count() == docs.count()
