"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every timing starts from the raw tables: derived inputs are dropped before each query. A first small query
starts the Python workers and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barframe import demo  # noqa: E402
from barframe.operators import features as ft  # noqa: E402
from barframe.plans.evaluate import evaluate  # noqa: E402
from workload import inputs  # noqa: E402
from workload.registry import REGISTRY  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("barframe-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def supplier_features(spark: SparkSession, d: str) -> DataFrame:
    return ft.features(demo.bars(spark, d, "supplier"))


def supplier_evaluation(spark: SparkSession, d: str) -> DataFrame:
    bars = demo.bars(spark, d, "supplier").unionByName(demo.bars(spark, d, "market"))
    return evaluate(bars, demo.BENCHMARK).stats


HEADLINE = {
    "derive_bars": REGISTRY["derive_bars"].run,
    "features_1000_symbols": supplier_features,
    "evaluate_1000_symbols": supplier_evaluation,
    "evaluate_25_symbols": REGISTRY["evaluate_stats"].run,
    "stock_regime": REGISTRY["stock_regime"].run,
    "alpha_ensemble": REGISTRY["ensemble"].run,
    "target_weights": REGISTRY["target_weights"].run,
    "rank_with_ties": REGISTRY["rank_with_ties"].run,
    "dedupe_last": REGISTRY["dedupe_last"].run,
    "cash_ledger": REGISTRY["cash_ledger"].run,
    "resample_hour": REGISTRY["resample_hour"].run,
    "train_walk_forward": REGISTRY["train_walk_forward"].run,
}


def main() -> None:
    spark = session()
    spark.range(1000).groupBy("id").applyInPandas(lambda p: p, "id long").count()
    times: dict[str, float] = {}
    for name, run in HEADLINE.items():
        inputs.forget()
        start = time.time()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}), flush=True)


if __name__ == "__main__":
    main()
