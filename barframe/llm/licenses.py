"""License scans by diagonal voting.

Templates are short phrases (exact) and license notices (with edits). Rolling hashes of ``k`` words of every text are joined to
the templates' hashes; a match at text word p and template word t votes for the diagonal p - t. Votes are counted by text,
template and diagonal; diagonals at most ``GAP`` apart (or as many words as a notice may lack), as insertions and deletions
leave them, are merged. Candidates with enough votes are verified on the words themselves: a phrase must stand there word by
word, a notice must cover ``COVERAGE`` of its words in order, its license's name among them.

Votes follow from the coverage. A notice of n words may lack e = n - ceil(COVERAGE * n) of them, and each changed, dropped or
parted place breaks at most k of its n - k + 1 grams: n - k + 1 - k * e are left. ``k`` is chosen for each notice so that this
is positive, so a notice with up to e such places, whose insertions are of ``GAP`` words at most in all, is always verified.

Templates are a fixed list, so their side of the join is small whatever the corpus; Spark broadcasts it by its size.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Defined cases: a null or empty text has no words and no
license; repeated rows get equal results (texts are told apart by a hash of id and text); overlapping places all count; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barframe.llm import words as wd
from barframe.plans.settle import settle

GAP = 3
COVERAGE = 0.8
FEW_VOTES = 3  # a longer gram is taken only if this many of them are sure to be left
COUNTED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split(text: str) -> list[bytes]:
    data, offsets = wd.buffers(pa.array([text]))
    w = wd.words(data, offsets, plain=True, lower=True)
    return [w.text(i) for i in range(len(w.hash))]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False
    name: str = ""  # words that tell the license from others: a notice without one of them is not accepted

    @property
    def words(self) -> list[bytes]:
        return split(self.text)

    @property
    def named(self) -> frozenset[bytes]:
        return frozenset(split(self.name))

    @property
    def lacking(self) -> int:
        """Words that may be missing."""
        n = len(self.words)
        return 0 if self.exact else n - math.ceil(COVERAGE * n)

    def left(self, k: int) -> int:
        """Grams of k words that are left when ``lacking`` places are changed."""
        return len(self.words) - k + 1 - k * self.lacking

    @property
    def k(self) -> int:
        if self.exact:
            return min(2, len(self.words))
        return next((k for k in (4, 3) if self.left(k) >= FEW_VOTES), min(2, len(self.words)))

    @property
    def votes(self) -> int:
        return max(1, self.left(self.k))


PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
#: Opening words and usual notices of public licenses.
NOTICES = (
    Template("mit", "released under the MIT License", name="MIT"),
    Template("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "licensed under the Apache License, Version 2.0", name="Apache"),
    Template("gpl", "this work is licensed under the GNU General Public License, version 3", name="GNU General Public"),
    Template("gpl", "this program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", name="GNU General Public"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", name="Lesser"),
    Template("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", name="BY NC"),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", name="BY SA"),
    Template("cc-by", "this work is licensed under a Creative Commons Attribution 4.0 International License", name="Attribution"),
    Template("mpl", "this source code form is subject to the terms of the Mozilla Public License, v. 2.0", name="Mozilla"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def text_key(id: str, text: str) -> Column:
    return F.xxhash64(F.col(id).cast("string"), F.col(text), F.col(id).isNull())


def template_grams(spark, templates: tuple[Template, ...]) -> DataFrame:
    """(gram, template, at): the rolling hashes of each template."""
    rows = []
    for i, t in enumerate(templates):
        data, offsets = wd.buffers(pa.array([t.text]))
        grams, at = wd.words(data, offsets, plain=True, lower=True).grams(t.k)
        rows += [(int(g), i, int(p)) for g, p in zip(grams.view(np.int64), at, strict=True)]
    return settle(spark.createDataFrame(rows, "gram long, template int, at int").coalesce(1), "templates")


def text_grams(docs: DataFrame, id: str, text: str, sizes: tuple[int, ...]) -> DataFrame:
    """(key, pos, gram): all rolling hashes of all texts, for each size."""

    def roll(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for lo, hi, w in wd.batch_words(batch.column("text"), plain=True, lower=True):
                rows = w.rows()
                pos = np.arange(len(rows)) - w.first[rows]
                own = keys[lo:hi][rows]
                for k in sizes:
                    grams, at = w.grams(k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(pos[at].astype(np.int32)), pa.array(grams.view(np.int64))], names=["key", "pos", "gram"])

    rows = docs.select(text_key(id, text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(roll, "key long, pos int, gram long")


def candidates(docs: DataFrame, templates: tuple[Template, ...], *, id: str, text: str, gap: int = GAP) -> DataFrame:
    """(key, template, low, high): merged diagonals with enough votes; low and high are text words where the template would start."""
    spark = docs.sparkSession
    grams = template_grams(spark, templates)
    hits = text_grams(docs, id, text, tuple(sorted({t.k for t in templates}))).join(grams, "gram")
    # The places of a template bound the set of a diagonal; rows that repeat a text add nothing to a set.
    lines = settle(hits.groupBy("key", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("places")), "diagonals")
    apart, need = F.lit(0), F.lit(1)
    for i, t in enumerate(templates):
        own = F.col("template") == i
        apart = F.when(own, 0 if t.exact else max(gap, t.lacking)).otherwise(apart)
        need = F.when(own, t.votes).otherwise(need)
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > apart
    runs = lines.withColumn("new", F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0)).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("key", "template", "run").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"))
    return runs.filter(F.col("votes") >= need).select("key", "template", "low", "high")


def verified(words: list[bytes], template: list[bytes], exact: bool, low: int, high: int, named: frozenset[bytes] = frozenset()) -> tuple[int, int, float] | None:
    """(start, end, coverage) of a template in the words of a text, near the diagonals low to high; None if it is not there."""
    if exact:
        return (low, low + len(template), 1.0) if low >= 0 and words[low : low + len(template)] == template else None
    a, b = max(0, low - GAP), min(len(words), high + len(template) + GAP)
    same = [m for m in SequenceMatcher(None, template, words[a:b], autojunk=False).get_matching_blocks() if m.size]
    covered = sum(m.size for m in same) / len(template)
    if covered < COVERAGE or not named <= {w for m in same for w in template[m.a : m.a + m.size]}:
        return None
    return a + same[0].b, a + same[-1].b + same[-1].size, covered


def license_spans(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, spans) for every row; spans are (label, exact, start, end, coverage) in words, sorted."""
    templates = (*phrases, *notices)
    wanted = [(t.label, t.exact, t.words, t.named) for t in templates]
    found = candidates(docs, templates, id=id, text=text).groupBy("key").agg(F.collect_list(F.struct("template", "low", "high")).alias("found"))
    found = settle(found, "candidates")
    keyed = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), text_key(id, text).alias("key"))
    texts = keyed.join(found.select("key"), "key", "left_semi").select("key", "text").dropDuplicates(["key"]).join(found, "key")
    kind = pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def verify(batches):
        for batch in batches:
            spans, lists = [], batch.column("found")
            for lo, hi, w in wd.batch_words(batch.column("text"), plain=True, lower=True):
                for r in range(hi - lo):
                    own = [w.text(i) for i in range(w.first[r], w.first[r + 1])]
                    got = set()
                    for c in lists[lo + r].as_py():
                        label, exact, words, named = wanted[c["template"]]
                        if place := verified(own, words, exact, c["low"], c["high"], named):
                            got.add((label, exact, *place))
                    spans.append([dict(zip(("label", "exact", "start", "end", "coverage"), s, strict=True)) for s in sorted(got)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, pa.list_(kind))], names=["key", "spans"])

    shape = "array<struct<label:string,exact:boolean,start:long,end:long,coverage:double>>"
    spans = texts.mapInArrow(verify, f"key long, spans {shape}")
    counted = keyed.select("id", "key", F.coalesce(F.regexp_count("text", F.lit(COUNTED)), F.lit(0)).cast("long").alias("n_words"))
    out = counted.join(settle(spans, "spans"), "key", "left")
    return out.select(F.col("id").alias(id), "n_words", F.coalesce("spans", F.expr(f"cast(array() as {shape})")).alias("spans"))
