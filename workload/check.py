"""Run registered queries beside their DuckDB counterparts: ``python -m workload.check [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("barframe-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark: SparkSession, sf_dir: str, run, sql: str | None) -> tuple[str, float, float]:
    t = time.time()
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(_plain(x) for x in row) for row in df.select(*[f"`{n}`" for n in names]).collect()]
    spent = time.time() - t
    if sql is None:
        return f"rows {len(got)}" if got else "EMPTY", spent, 0.0
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    t = time.time()
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    rows = res.fetchall()
    oracle = time.time() - t
    if sorted(cols) != names:
        return f"COLUMNS {names} != {sorted(cols)}", spent, oracle
    at = [cols.index(n) for n in names]
    want = [tuple(_plain(row[i]) for i in at) for row in rows]
    if len(got) != len(want):
        return f"COUNT {len(got)} != {len(want)}", spent, oracle
    diff = [(a, b) for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)) if a != b]
    if diff:
        return f"DIFF {len(diff)} of {len(got)}: {names} {diff[0][0]} != {diff[0][1]}", spent, oracle
    return f"ok {len(got)}", spent, oracle


def main() -> int:
    from workload.registry import REGISTRY

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = session()
    bad = 0
    for name, entry in REGISTRY.items():
        if args and not any(a in name for a in args):
            continue
        try:
            verdict, spent, oracle = compare(spark, sf_dir, entry.run, entry.sql)
        except Exception as exc:  # report and go on to the next query
            verdict, spent, oracle = f"ERROR {str(exc)[:600]}", 0.0, 0.0
        bad += verdict.split()[0] not in ("ok", "rows")
        print(f"{name:32s} {spent:6.2f}s {oracle:6.2f}s {verdict}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
