"""The corpus pipeline: toxic texts out, one of each group of near copies, no benchmark texts, a mix by source, token files.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what each
stage keeps as a table in the shared folder and reads it again as the next stage's documents, so a lost executor repeats
at most the stage at hand. All stages but the last return the columns of ``documents``; the last returns, for each document
of the token files in order, doc_id, start, n_tokens and ids_crc32. A document that the mix takes more than once is there
as often.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barframe.llm import benchmarks, jaccard, mixing, tokenfile, toxicity
from barframe.llm.queries import table, tokenizer
from barframe.plans.settle import settle


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmarks.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", benchmark_out),
    ("source_mixing", mix_sources),
    ("token_binary_output", token_files),
]

#: A fitted model and a seeded choice have no SQL; a test holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
