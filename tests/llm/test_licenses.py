import random
import re

from barframe.llm import licenses as lc
from barframe.llm import words as wd

LOW = str.maketrans(wd.UPPER, wd.LOWER)


def split(t):
    return re.findall(wd.PLAIN, (t or "").translate(LOW))


def places(text):
    w, out = split(text), []
    for t in lc.PHRASES:
        p = split(t.text)
        out += [(t.label, i) for i in range(len(w)) if w[i : i + len(p)] == p]
    return sorted(out)


def test_phrases_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["MIT", "license", "apache", "General", "public", "License,", "the", "of\n"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randrange(0, 50)))) for i in range(150)] + [(3, "mit license"), (3, "mit license"), (200, None), (201, "")]
    got = lc.license_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = sorted((r.doc_id, r.n_words, sorted((s.label, s.start) for s in r.spans if s.exact)) for r in got)
    assert found == sorted((i, len(split(t)), places(t)) for i, t in docs)


def test_notices_with_edits(spark):
    filler = " ".join(f"f{i}" for i in range(40))
    mit = next(t.text for t in lc.NOTICES if t.text.startswith("permission"))
    rows = [(1, f"{filler} {mit} {filler}"), (2, f"{filler} {mit.replace('hereby ', '').replace('of this software', 'of the present software')}"),
            (3, " ".join(mit.split()[:9])), (4, f"Licensed under CC BY-NC 4.0. {filler}"), (5, " ".join(reversed(mit.split())))]
    got = {r.doc_id: r.spans for r in lc.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.label, s.start, s.end, s.coverage) for s in got[1]] == [("mit", 40, 40 + len(split(mit)), 1.0)]
    assert [s.label for s in got[2]] == ["mit"] and got[2][0].start == 40 and 0.8 <= got[2][0].coverage < 1
    assert got[3] == [] and [s.label for s in got[4]] == ["cc-by-nc"] and got[5] == []


def test_every_edited_notice_that_would_be_accepted_is_found(spark):
    before, after = [f"f{i}" for i in range(30)], [f"g{i}" for i in range(30)]
    rows, want = [], {}
    for notice in lc.NOTICES:
        words = split(notice.text)
        for step in range(5, 9):
            for first in range(step):
                for edit in ("change", "drop", "insert"):
                    new = []
                    for i, w in enumerate(words):
                        at = i % step == first
                        new += [w] if not at else [f"e{i}"] if edit == "change" else [] if edit == "drop" else [w, f"e{i}"]
                    whole = [*before, *new, *after]
                    places = sum(i % step == first for i in range(len(words)))
                    if lc.verified([w.encode() for w in whole], notice.words, False, 30, 30, notice.named) and (edit != "insert" or places <= notice.lacking):
                        want[len(rows)] = notice.label
                    rows.append((len(rows), " ".join(whole)))
    got = {r.doc_id: r.spans for r in lc.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 300
    assert [i for i, label in want.items() if not any(s.label == label and s.start < 60 and s.end > 30 for s in got[i])] == []


def test_another_licenses_name_is_not_an_edit(spark):
    rows = [(1, "released under the Apache License"), (2, "under the terms of the GNU General Public License"), (3, "licensed under CC BY-SA 4.0"), (4, "released under an MIT License")]
    got = {r.doc_id: [s.label for s in r.spans if not s.exact] for r in lc.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: ["cc-by-sa"], 4: ["mit"]}


def test_votes_follow_from_the_coverage():
    for n in range(1, 60):
        t = lc.Template("x", " ".join(f"w{i}" for i in range(n)))
        assert t.votes >= 1 and t.left(t.k) >= (1 if n > 1 else t.left(1)) and n - t.lacking >= lc.COVERAGE * n


def test_odd_rows(odd, empty):
    got = lc.license_spans(odd).collect()
    assert len(got) == 8 and all(r.spans == [] for r in got) and sorted(r.n_words for r in got)[:3] == [0, 0, 0]
    assert lc.license_spans(empty).count() == 0
