import random
import re

from barframe.llm import queries
from barframe.llm import rules as ru
from barframe.llm import words as wd


def brute(text):
    t = text or ""
    w = re.findall(wd.SPACED, t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(wd.SPACED, x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in ru.SYMBOLS for c in t), "n_exclamations": t.count("!"),
            "n_upper": sum("A" <= c <= "Z" for c in t), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def rejects(rule, m):
    return eval(rule.fails.replace("=", "=="), {}, m)  # noqa: S307  rules use <, > and * only


def corpus():
    rng = random.Random(2)
    texts = [None, "", " \n ", "a a a a", "Ünï 漢字 #$ !!\x0bx\x0cy", "x y z " * 40, "one line here\n" * 20]
    for _ in range(60):
        words = rng.choices(["alpha", "Beta", "g#", "d!", "EPS", "zeta\n", "eta\n", "|"], [8, 4, 1, 1, 1, 1, 1, 1], k=rng.randrange(0, 120))
        texts.append(" ".join(words))
    return list(enumerate(texts))


def test_measures_and_verdicts(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {r.doc_id: r for r in ru.cascade(docs, all_measures=True).collect()}
    order = [e.rule for e in ru.estimate(docs, ru.BASE + ru.OWN)]
    quick = {r.doc_id: r.rejected_by for r in ru.cascade(docs).collect()}
    for i, t in corpus():
        m = brute(t)
        assert {k: got[i][k] for k in m} == m, t
        first = next((r.name for r in order if rejects(r, m)), None)
        assert got[i].rejected_by == first and quick[i] == first


def test_cascade_measures_only_what_it_needs(spark):
    docs = spark.createDataFrame([(1, "few words"), (2, "many words " * 60)], "doc_id long, text string")
    order = list(ru.BASE)
    got = {r.doc_id: r for r in ru.cascade(docs, ru.BASE, order=order).collect()}
    assert got[1].rejected_by == "too_few_words" and got[1].n_repeat_words is None and got[2].n_repeat_words == 120
    est = ru.estimate(docs, ru.BASE + ru.OWN)
    gains = [e.rejected / e.cost for e in est]
    assert gains == sorted(gains, reverse=True) and est[0].rule.name == "too_few_words"


def test_query_measures_its_columns_always_and_others_while_open(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    calls, cascade = [], ru.cascade
    monkeypatch.setattr(queries.rules, "cascade", lambda *a, **b: calls.append(cascade(*a, **b)) or calls[-1])
    got = {r.doc_id: r for r in queries.QUERIES["op5_quality_rules"](spark, str(tmp_path)).collect()}
    whole = {r.doc_id: r for r in cascade(docs, all_measures=True).collect()}
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, _ in corpus():
        assert all(got[i][c] == whole[i][c] for c in wanted) and got[i].kept == (whole[i].rejected_by is None)
    inner = {r.doc_id: r for r in calls[0].collect()}
    assert any(r.rejected_by and r.n_upper is None for r in inner.values())
    assert all(r.n_upper is not None and r.n_exclamations is not None and r.n_lines is not None for r in inner.values() if not r.rejected_by)


def test_odd_rows(odd, empty):
    got = ru.cascade(odd, all_measures=True).collect()
    assert len(got) == 8 and sum(r.n_words == 30_000 for r in got) == 1
    assert ru.cascade(empty, all_measures=True).count() == 0
