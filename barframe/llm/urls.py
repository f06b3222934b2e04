"""URL filters: listed rules first, then association rules that FP-growth mines from the listed ones, DataFrame functions only.

A listed rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's; the longest wins.
URLs that a listed rule fits are the labelled ones. Their tokens (host labels, path segments by place, first characters of
path segments, kind of a segment's characters) and their verdict are transactions; FP-growth finds the frequent token
combinations, and rules from combinations to a verdict stay if confidence and support reach their bounds and no rule
with one token less is as confident. Rules are matched by an inverted index: each hangs at its rarest token, and the rest
is tested where that token occurs. Of the rules that match, the most confident decides, then the best supported; without
any the verdict is ``allow``.

Tokens of all labelled URLs say nothing and are left out; of tokens that occur in the same URLs one stands for all, so
repeated long paths do not multiply combinations. Verdicts depend on the URL alone, so each different URL is judged once.

Defined cases: a null URL or one without ``://`` has an empty host and path and no tokens; without labelled URLs of both
verdicts nothing is mined; repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.llm import words as wd
from barframe.plans.settle import settle

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT = 0.002
LEAST_URLS = 5
CONFIDENCE = 0.9


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), wd.UPPER, wd.LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. Of equally long ones the longer host wins, then the name."""
    chain = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in chain]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))
    return pick([h + p for _, h, p in chain]), pick([v for v, _, _ in chain])


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    kind = lambda x: F.regexp_replace(F.regexp_replace(x, "[0-9]+", "0"), "[A-Za-z]+", "a")
    place = lambda i: F.when(i < 4, i.cast("string")).otherwise("+")
    found = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host "), x)),
        F.transform(parts, lambda x, i: F.concat(F.lit("path"), place(i), F.lit(" "), x)),
        F.transform(parts, lambda x, i: F.concat(F.lit("start"), place(i), F.lit(" "), F.substring(x, 1, 1))),
        F.transform(parts, lambda x, i: F.concat(F.lit("kind"), place(i), F.lit(" "), kind(x))))
    return F.array_distinct(found)


def mined_rules(labelled: DataFrame, *, support: float = SUPPORT, least_urls: int = LEAST_URLS, confidence: float = CONFIDENCE) -> DataFrame | None:
    """(tokens, anchor, verdict, confidence, support) from (url, tokens, verdict); None if only one verdict occurs."""
    spark = labelled.sparkSession
    kinds = {r.verdict: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    total = sum(kinds.values())
    if len(kinds) < 2:
        return None
    least = max(support, least_urls / total)
    each = labelled.select("url", F.explode("tokens").alias("token"))
    uses = each.groupBy("token").agg(F.count("*").alias("uses"), F.sum(F.xxhash64("url").cast("decimal(38,0)")).alias("where"))
    uses = uses.filter((F.col("uses") >= least * total) & (F.col("uses") < total))
    stand = settle(uses.groupBy("uses", "where").agg(F.min("token").alias("token")).select("token", "uses"), "url_tokens")
    kept = each.join(stand.select("token"), "token").groupBy("url").agg(F.collect_list("token").alias("tokens"))
    items = labelled.select("url", "verdict").join(kept, "url", "left")
    items = items.select(F.concat(F.coalesce("tokens", F.expr("cast(array() as array<string>)")), F.array(F.concat(F.lit("= "), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(settle(items, "url_items"))
    found = model.associationRules.filter(F.col("consequent")[0].startswith("= ") & ~F.exists("antecedent", lambda x: x.startswith("= ")))
    found = settle(found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 3, 10).alias("verdict"), "confidence", "support"), "url_rules")
    less = found.withColumn("part", F.explode("tokens")).select("tokens", "verdict", "confidence", F.array_except("tokens", F.array("part")).alias("smaller"))
    as_good = found.select(F.col("tokens").alias("smaller"), "verdict", F.col("confidence").alias("smaller_confidence"))
    worse = less.join(as_good, ["smaller", "verdict"]).filter("smaller_confidence >= confidence").select("tokens", "verdict").distinct()
    found = found.join(worse, ["tokens", "verdict"], "left_anti")
    rarest = found.withColumn("token", F.explode("tokens")).join(stand, "token").groupBy("tokens", "verdict").agg(F.min(F.struct("uses", "token"))["token"].alias("anchor"))
    found = found.join(rarest, ["tokens", "verdict"])
    return settle(found.select("tokens", "anchor", "verdict", "confidence", "support"), "url_rules")


def judged(pages: DataFrame, *, id: str = "page_id", url: str = "url", rules=RULES, support: float = SUPPORT, least_urls: int = LEAST_URLS,
           confidence: float = CONFIDENCE) -> DataFrame:
    """(id, host, path, rule, verdict, by) for every row; ``by`` is ``list``, ``mined`` or ``default``."""
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    parsed = rows.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    parsed = settle(parsed.select("url", "host", "path", name.alias("rule"), verdict.alias("verdict"), tokens(F.col("host"), F.col("path")).alias("tokens")), "urls")
    mined = mined_rules(parsed.filter("verdict is not null").select("url", "tokens", "verdict"), support=support, least_urls=least_urls, confidence=confidence)
    out = parsed.select("url", "host", "path", "rule", "verdict")
    if mined is None:
        out = out.withColumn("mined", F.lit(None).cast("string"))
    else:
        # A combination was mined from tokens that stand for others, so only its own tokens are asked for.
        open_ = parsed.filter("verdict is null and url is not null").select("url", "tokens", F.explode("tokens").alias("anchor"))
        index = mined.select("anchor", F.col("tokens").alias("wanted"), F.col("verdict").alias("mined"), "confidence", "support")
        met = open_.join(index, "anchor").filter(F.size(F.array_except("wanted", "tokens")) == 0)
        best = met.groupBy("url").agg(F.max(F.struct("confidence", "support", F.array_join("wanted", " ").alias("name"), "mined"))["mined"].alias("mined"))
        out = out.join(best, "url", "left")
    by = F.when(F.col("verdict").isNotNull(), "list").when(F.col("mined").isNotNull(), "mined").otherwise("default")
    out = settle(out.select(F.col("url").alias("_url"), "host", "path", "rule", F.coalesce("verdict", "mined", F.lit("allow")).alias("verdict"), by.alias("by")), "verdicts")
    full = rows.join(out, rows.url.eqNullSafe(out["_url"]), "left")
    return full.select(F.col("id").alias(id), "host", "path", "rule", "verdict", "by")
