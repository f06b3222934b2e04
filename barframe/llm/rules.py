"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a boolean Column over a document's measures and the cost of its measures. On a sample (``SAMPLE`` rows at most, the
first by a hash of id and text) every rule's rejection rate and cost are estimated: the cost is the work that its
measures need on the sample (characters, words or lines touched, weighted by ``UNIT_COST``), so that estimates do not
depend on a clock and reruns agree. Rules run in falling order of rejection per cost, as nested CASE WHEN: a text that one rule
rejects never reaches the measures of a later, dearer one. The order changes the time only; a verdict is the same in any.

Defined cases: a null or empty text has no words and fails ``too_few_words``; an empty table keeps the rules' given order;
repeated rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.llm import words as wd
from barframe.plans.settle import settle

SAMPLE = 2000
#: Relative work of one unit, by kind of scan.
UNIT_COST = {"chars": 1.0, "words": 12.0, "lines": 40.0, "windows": 90.0}
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over measures, true for a text to reject; ``measures`` names those that it reads."""

    name: str
    fails: str
    measures: tuple[str, ...]


BASE = (
    Rule("too_few_words", "n_words < 50", ("n_words",)),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", ("n_repeat_words", "n_words")),
)
OWN = (
    Rule("symbols", "100 * n_symbols > 15 * n_words", ("n_symbols", "n_words")),
    Rule("exclamations", "100 * n_exclamations > 30 * n_words", ("n_exclamations", "n_words")),
    Rule("upper_case", "100 * n_upper > 50 * word_chars", ("n_upper", "word_chars")),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines", ("n_dup_lines", "n_lines")),
)
#: Scans of each measure.
UNITS = {"n_words": ("words",), "word_chars": ("chars",), "n_symbols": ("chars",), "n_exclamations": ("chars",), "n_upper": ("chars",),
         "n_lines": ("lines",), "n_dup_lines": ("lines", "lines"), "n_repeat_words": ("words", "windows")}
MEASURES = tuple(UNITS)


def _without(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(wd.SPACED))


def _simple(name: str, text: Column) -> Column:
    if name == "n_words":
        return F.regexp_count(text, F.lit(wd.SPACED)).cast("long")
    if name == "word_chars":
        return F.length(F.translate(text, SPACES, "")).cast("long")
    if name == "n_symbols":
        return _without(text, SYMBOLS)
    if name == "n_exclamations":
        return _without(text, "!")
    if name == "n_upper":
        return _without(text, wd.UPPER)
    if name == "n_lines":
        return F.size(_lines(text)).cast("long")
    # Lines with a word that equal an earlier line: all but the first of each.
    return F.aggregate(F.array(_lines(text)), F.lit(0).cast("long"), lambda _, x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _measured(df: DataFrame, name: str, text: str, alive: Column) -> DataFrame:
    """``df`` with the measure ``name``, computed where ``alive`` only. Helper columns start with an underscore."""
    if name != "n_repeat_words":
        return df.withColumn(name, F.when(alive, _simple(name, F.col(text))))
    # Windows of three words, sorted by a 64-bit hash with their places: neighbours with equal hashes are repeats. Words
    # covered by the sorted places of repeats are counted by the gaps between them.
    w, s = F.col("_words"), F.col("_spots")
    df = df.withColumn("_words", F.when(alive, F.regexp_extract_all(F.col(text), F.lit(wd.SPACED), F.lit(0))))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    df = df.withColumn("_spots", F.sort_array(F.when(F.size(w) >= 3, windows).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))))
    rest = F.greatest(F.size(s) - 1, F.lit(0))
    same = F.zip_with(F.slice(s, F.lit(1), rest), F.slice(s, F.lit(2), rest), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("p"))
    count = F.aggregate(places, first, lambda c, p: F.struct((c["n"] + F.least(F.lit(3), p - c["p"])).alias("n"), p.alias("p")), lambda c: c["n"])
    return df.withColumn(name, F.when(alive, count)).drop("_words", "_spots")


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    cost: float


def estimate(docs: DataFrame, rules: tuple[Rule, ...], *, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[Estimate]:
    """Rejection rate and cost of each rule on the sample, in the order in which the cascade runs them."""
    # Rows below a bound of the hash, about twice the sample, are written first: so nothing is measured on other rows.
    order = F.xxhash64(F.col(id).cast("string"))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), order.alias("_order"))
    share = min(1.0, 2 * sample / max(1, docs.count()))
    if share < 1:
        rows = rows.filter(F.col("_order") < int((2 * share - 1) * (1 << 63)))
    rows = settle(rows, "rule_sample").orderBy("_order", F.xxhash64("_text")).limit(sample)
    rows = settle(rows, "rule_sample")
    for m in MEASURES:
        if any(m in r.measures for r in rules):
            rows = _measured(rows, m, "_text", F.lit(True))
    parts = [F.avg(F.coalesce(F.expr(r.fails), F.lit(False)).cast("double")).alias(f"r{i}") for i, r in enumerate(rules)]
    text_ = F.col("_text")
    for name, size in (("chars", F.length(text_)), ("words", F.regexp_count(text_, F.lit(wd.SPACED))), ("lines", F.size(F.split(text_, "\n", -1)))):
        parts.append(F.coalesce(F.avg(size), F.lit(0.0)).alias(name))
    got = rows.agg(*parts).first()
    work = {u: UNIT_COST[u] * got["words" if u == "windows" else u] for u in UNIT_COST}
    found = [Estimate(r, got[f"r{i}"] or 0.0, sum(work[u] for m in r.measures for u in UNITS[m])) for i, r in enumerate(rules)]
    return sorted(found, key=lambda e: -e.rejected / max(e.cost, 1e-9))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE + OWN, *, id: str = "doc_id", text: str = "text", all_measures: bool = False,
            sample: int = SAMPLE, order: list[Rule] | None = None, always: tuple[str, ...] = ()) -> DataFrame:
    """(id, measures, rejected_by): the first rule of the cascade that a text fails, or null.

    A text that a rule rejects is not measured for later ones (their measures are null), unless ``all_measures``; the
    measures in ``always`` are taken of every text.
    """
    order = order or [e.rule for e in estimate(docs, rules, id=id, text=text, sample=sample)]
    df, known = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")), []
    if all_measures:
        for m in MEASURES:
            df, known = _measured(df, m, "_text", F.lit(True)), [*known, m]
        verdict = F.coalesce(*[F.when(F.expr(r.fails), F.lit(r.name)) for r in order])
        return df.select(F.col("_id").alias(id), *known, verdict.alias("rejected_by"))
    for m in always:
        df, known = _measured(df, m, "_text", F.lit(True)), [*known, m]
    df = df.withColumn("rejected_by", F.lit(None).cast("string"))
    for r in order:
        for m in r.measures:
            if m not in known:
                df, known = _measured(df, m, "_text", F.col("rejected_by").isNull()), [*known, m]
        df = df.withColumn("rejected_by", F.coalesce("rejected_by", F.when(F.expr(r.fails), F.lit(r.name))))
    return df.select(F.col("_id").alias(id), *known, "rejected_by")
