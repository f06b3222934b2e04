import itertools
import re

from pyspark.sql import functions as F

from barframe.llm import urls as ur


def parse(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u[u.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def listed(host, path):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in ur.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/é",
        "http://com/de/", "http://notcom/de/", "http://a.b.com?q=/de/", "http://EXAMPLE.com#/fr/", "x://y://org/z", "http://org/\nline", "http://Ä.org/es/"]
URLS += [f"http://h{i % 5}.example.{t}/{lang}/{i}" for i in range(40) for t in ("org", "com", "net") for lang in ("en", "de", "fr", "es")]


def test_lists_and_parsing(spark):
    pages = spark.createDataFrame(list(enumerate([*URLS, URLS[4]])), "page_id long, url string")
    for r in ur.judged(pages).join(pages, "page_id").collect():
        host, path = parse(r.url)
        rule, verdict = listed(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert verdict is None or (r.verdict == verdict and r.by == "list")
        assert r.verdict in ("allow", "block")
    assert ur.judged(pages).count() == len(URLS) + 1


def test_mined_rules_against_all_combinations(spark):
    pages = spark.createDataFrame([(u,) for u in sorted({u for u in URLS if u})], "url string")
    host, path = ur.host_and_path(F.col("url"))
    rule, verdict = ur.listed(host, path)
    rows = pages.select("url", ur.tokens(host, path).alias("tokens"), verdict.alias("verdict")).filter("verdict is not null")
    mined = {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in ur.mined_rules(rows, support=0.02, confidence=0.9).collect()}
    items = [(set(r.tokens), r.verdict) for r in rows.collect()]
    total, least = len(items), max(0.02, 5 / len(items))
    where = {}
    for i, (t, _) in enumerate(items):
        for x in t:
            where.setdefault(x, set()).add(i)
    stand = {}
    for x, at in sorted(where.items()):
        if least * total <= len(at) < total:
            stand.setdefault(frozenset(at), x)
    names = sorted(stand.values())
    found = {}
    for k in range(1, 5):
        for combo in itertools.combinations(names, k):
            have = set.intersection(*(where[x] for x in combo))
            for v in ("allow", "block"):
                n = sum(items[i][1] == v for i in have)
                if n and n >= least * total and n / len(have) >= 0.9:
                    found[combo, v] = n / len(have), n / total
    kept = {(c, v): (round(a, 9), round(b, 9)) for (c, v), (a, b) in found.items()
            if not any(found.get((tuple(x for x in c if x != y), v), (0,))[0] >= a for y in c)}
    assert {k: v for k, v in mined.items() if len(k[0]) <= 4} == kept and kept
    assert (("path0 es",), "block") in kept or any("es" in " ".join(c) for c, _ in kept)


def test_nothing_to_mine(spark):
    pages = spark.createDataFrame([(1, "http://x.net/en/1"), (None, None), (1, "http://x.net/en/1")], "page_id long, url string")
    assert sorted((r.page_id or 0, r.host, r.rule, r.verdict, r.by) for r in ur.judged(pages).collect()) == [
        (0, "", None, "allow", "default"), (1, "x.net", None, "allow", "default"), (1, "x.net", None, "allow", "default")]
    assert ur.judged(pages.limit(0)).count() == 0


def test_every_rule_within_the_bounds_stays(spark):
    rows = [(f"u{i}", [f"t{i}"], "allow" if i % 2 else "block") for i in range(8192)]
    labelled = spark.createDataFrame(rows, "url string, tokens array<string>, verdict string")
    got = ur.mined_rules(labelled, support=0.0, least_urls=1).collect()
    assert sorted((f"u{r.anchor[1:]}", r.tokens, r.verdict) for r in got) == sorted(rows)
