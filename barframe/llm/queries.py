"""Registered queries of the text operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.llm import benchmarks, edits, jaccard, licenses, lines, merkle, mixing, phrases, quality, rules, tokenfile, toxicity, urls
from barframe.llm import words as wd
from barframe.plans.settle import settle


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Place of a vocabulary file; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWERED = f"translate(coalesce(text, ''), '{wd.UPPER}', '{wd.LOWER}')"
_PLAIN_WORDS = f"regexp_extract_all({_LOWERED}, '{wd.PLAIN}')"
_SPACED_WORDS = f"regexp_extract_all(coalesce(text, ''), '{wd.SPACED}')"
_SPACED_LOW = f"regexp_extract_all({_LOWERED}, '{wd.SPACED}')"


@query("op10_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, k, array_to_string(w[p + 1 : p + k], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS p FROM i)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
hits AS (SELECT doc_id, dw.k, p, item FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hits) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmarks.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = benchmarks.hit_words(F.col("spans"))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op4_ngram_jaccard_join", f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED_LOW} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_token_binary_output")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(table(spark, sf_dir, "documents"), tokenizer())


@query("op6_source_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_toxic_words", "spans")


@query("op5_quality_rules", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_SPACED_WORDS} AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS p FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS x FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
      WHERE regexp_matches(l, '{wd.SPACED}') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '{rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, length(t) - length(translate(t, '!', '')) AS ex,
             length(t) - length(translate(t, '{wd.UPPER}', '')) AS up, coalesce(n_lines, 0) AS n_lines
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 15 * n_words OR 100 * ex > 30 * n_words OR 100 * up > 50 * word_chars OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM b""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = rules.cascade(table(spark, sf_dir, "documents"), always=wanted)
    base = F.expr(" or ".join(f"({r.fails})" for r in rules.BASE))
    return judged.select("doc_id", *wanted, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


@query("op8_url_filters")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    start = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
                        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), score.alias("score"))


@query("op3_line_dedup", f"""
WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS i, spot, line, len(regexp_extract_all(line, '{wd.SPACED}')) AS n
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents)
           WHERE regexp_matches(line, '{wd.SPACED}')),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
e AS (SELECT a.doc_id, a.i, min(b.i) AS last FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY ALL),
w AS (SELECT e.doc_id, e.i, string_agg(l.line, chr(10) ORDER BY l.i) AS body FROM e JOIN l ON l.doc_id = e.doc_id AND l.i BETWEEN e.i AND e.last GROUP BY ALL),
f AS (SELECT body, min(struct_pack(d := doc_id, i := i)) AS first FROM w GROUP BY body HAVING count(*) > 1),
m AS (SELECT w.doc_id, w.i, f.first.d AS d0, w.i - f.first.i AS diag FROM w JOIN f USING (body) WHERE struct_pack(d := w.doc_id, i := w.i) > f.first),
p AS (SELECT DISTINCT doc_id, d0, diag FROM m),
q AS (SELECT p.doc_id, p.d0, p.diag, a.i, a.i - row_number() OVER (PARTITION BY p.doc_id, p.d0, p.diag ORDER BY a.i) AS island
      FROM p JOIN l a ON a.doc_id = p.doc_id JOIN l b ON b.doc_id = p.d0 AND b.i = a.i - p.diag AND b.line = a.line),
k AS (SELECT DISTINCT q.doc_id, q.d0, q.diag, q.island FROM q JOIN m ON m.doc_id = q.doc_id AND m.d0 = q.d0 AND m.diag = q.diag AND m.i = q.i),
g AS (SELECT DISTINCT q.doc_id, q.i FROM q JOIN k USING (doc_id, d0, diag, island)),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, sum(CASE WHEN g.i IS NOT NULL THEN l.n ELSE 0 END) AS n_words_removed,
             list(l.spot) FILTER (g.i IS NOT NULL) AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_words_removed, 0) AS BIGINT) AS n_words_removed,
       CASE WHEN coalesce(n_removed, 0) = 0 THEN text
            ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text
FROM documents d LEFT JOIN r USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeats(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    state = settle(edits.count_tokens(docs, tokenizer()), "trees")
    return edits.apply_edits(docs, state, edits.scrub_edits(docs), tokenizer()).select("doc_id", "n_before", "n_edits", "n_after", "n_reencoded")


@query("op11_quality_classifier")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_phrase_mining", f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[s + 1 : s + k], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM w, range(1, 5) t(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT x.lang, x.phrase, x.a, x.i AS i, l.a AS l, r.a AS r, CAST((CAST(2000000 AS HUGEINT) * x.a) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
      FROM (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS i FROM c) x
      JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : x.i], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.i + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
h AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, array_to_string(w[o + 1 : o + z], ' ') AS phrase FROM (SELECT lang, a, w, z, unnest(range(0, k - z + 1)) AS o FROM c, range(2, 4) t(z) WHERE z < k)) GROUP BY ALL),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, score
      FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE NOT coalesce(100 * CAST(longer AS HUGEINT) >= 80 * CAST(b.a AS HUGEINT), false))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def _tampered_text() -> F.Column:
    """The text as it is stored by someone who lower-cases A-Z in the rows whose id's crc32 5 divides."""
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.translate("text", wd.UPPER, wd.LOWER)).otherwise(F.col("text"))


_CRC_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch) >> b) & 1)))"
_FIELDS = "concat({}, {}, {}, {}, {})".format(*[f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')" for c in ("doc_id", "source", "lang", "n_chars")], "{}")
_LEAF = lambda text: "sha256(" + _FIELDS.format(f"coalesce(concat(strlen({text}), ':', {text}), '-')") + ")"
_OTHERS = "string_agg({h}, '' ORDER BY pos) OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN {rows})"


def _with_others(nodes: str) -> str:
    left, right = (_OTHERS.format(h="h", rows=r) for r in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
    return f"SELECT tree, lvl, pos, coalesce({left}, '') AS lft, coalesce({right}, '') AS rgt FROM {nodes} WHERE n > 1"


@query("op13_merkle_manifest", f"""
WITH RECURSIVE c AS (SELECT *, list_reduce(list_concat([4294967295], {_CRC_BITS}), lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1))) AS s FROM documents),
d AS (SELECT doc_id, source, text, {_LEAF("text")} AS leaf, coalesce(xor(s, 4294967295) % 5 = 0, false) AS hit,
             {_LEAF(f"translate(text, '{wd.UPPER}', '{wd.LOWER}')")} AS low FROM c),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM l
      UNION ALL SELECT tree, lvl + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, lvl, pos // 16),
r AS (SELECT tree, lvl, h AS subroot FROM t WHERE n = 1),
u AS (SELECT CAST(-1 AS BIGINT) AS tree, 0 AS lvl, tree AS pos, (SELECT count(*) FROM r) AS n, subroot AS h FROM r
      UNION ALL SELECT tree, lvl + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY tree, lvl, pos // 16),
o AS ({_with_others("t")} UNION ALL {_with_others("u")}),
steps AS (SELECT l.tree, l.pos AS spot, o.lvl AS step, lft, rgt FROM l JOIN o ON o.tree = l.tree AND o.pos = l.pos // CAST(pow(16, o.lvl) AS BIGINT)
          UNION ALL SELECT l.tree, l.pos, r.lvl + o.lvl, lft, rgt FROM l JOIN r USING (tree) JOIN o ON o.tree = -1 AND o.pos = l.tree // CAST(pow(16, o.lvl) AS BIGINT)),
p AS (SELECT tree, spot, sha256(string_agg(concat(lft, rgt), '' ORDER BY step)) AS proof FROM steps GROUP BY tree, spot),
f AS (SELECT tree, pos AS spot, 0 AS step, CASE WHEN hit THEN low ELSE leaf END AS h FROM l
      UNION ALL SELECT f.tree, f.spot, f.step + 1, sha256(concat(lft, f.h, rgt)) FROM f JOIN steps USING (tree, spot, step)),
e AS (SELECT tree, spot, h FROM f QUALIFY row_number() OVER (PARTITION BY tree, spot ORDER BY step DESC) = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
FROM l JOIN r USING (tree) JOIN e ON e.tree = l.tree AND e.spot = l.pos LEFT JOIN p ON p.tree = l.tree AND p.spot = l.pos, (SELECT h AS root FROM u WHERE n = 1)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars")
    made = merkle.manifest(table(spark, sf_dir, "documents"), carry={"seen": merkle.digest(*fields, _tampered_text())})
    folded = merkle.fold(F.col("seen"), F.col("path"))
    rows = made.leaves.select("doc_id", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
