"""The versioned bar history: merges in both formats, stopped merges, null partitions, kept versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barframe.sources import history as hs

SCHEMA = "symbol string, date date, close double, note string, year int"


def row(symbol, day, close, note="x"):
    date = day and dt.date.fromisoformat(day)
    return symbol, date, close, note, date and date.year


OLD = [row("A", "2020-01-02", 1.5), row("A", "2021-01-04", 2.5, ""), row("B", "2021-01-04", None, None), row("B", "2022-01-03", 0.1 + 0.2), row("C", None, 7.0)]
NEW = [row("A", "2021-01-04", 9.25), row("A", "2021-01-05", 3.5, ' a "b", c'), row("D", "2023-01-02", 1e-300), row("C", None, 8.0)]


def rows(df):
    return sorted(map(tuple, df.select("symbol", "date", "close", "note", "year").collect()), key=str)


def merged():
    table = {r[:2]: r for r in OLD} | {r[:2]: r for r in NEW}
    return sorted(table.values(), key=str)


def test_both_formats_hold_the_merged_rows(spark, frame, tmp_path):
    path = str(tmp_path / "h")
    assert hs.upsert_history(spark, path, frame([*OLD, OLD[0]], SCHEMA), "year") == 1
    new = frame(NEW, SCHEMA).withColumn("further", F.lit(1))
    assert hs.upsert_history(spark, path, new, "year") == 2
    for fmt in hs.FORMATS:
        assert rows(hs.read_history(spark, path, fmt)) == merged()
        assert rows(hs.read_history(spark, path, fmt, version=1)) == sorted(OLD, key=str)
    folders = {p.name for p in (tmp_path / "h" / "parquet" / "version=2").iterdir() if "=" in p.name}
    assert folders == {"year=2021", "year=2023", "year=__HIVE_DEFAULT_PARTITION__"}  # untouched years stay where they are


@pytest.mark.parametrize("stop", ["csv", "publish"])
def test_a_merge_that_stops_leaves_the_old_table(spark, frame, tmp_path, monkeypatch, stop):
    path = str(tmp_path / "h")
    hs.upsert_history(spark, path, frame(OLD, SCHEMA), "year")

    def fail(*args, **kwargs):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        if stop == "publish":
            m.setattr(hs, "_publish", fail)
        else:
            m.setattr(hs, "_write", lambda df, folder, fmt, *rest, w=hs._write: fail() if fmt == "csv" else w(df, folder, fmt, *rest))
        with pytest.raises(OSError):
            hs.upsert_history(spark, path, frame(NEW, SCHEMA), "year")
    for fmt in hs.FORMATS:
        assert rows(hs.read_history(spark, path, fmt)) == sorted(OLD, key=str)
    assert hs.upsert_history(spark, path, frame(NEW, SCHEMA), "year") == 2
    for fmt in hs.FORMATS:
        assert rows(hs.read_history(spark, path, fmt)) == merged()


def test_versions_empty_tables_and_refusals(spark, frame, tmp_path):
    path = str(tmp_path / "h")
    with pytest.raises(FileNotFoundError):
        hs.read_history(spark, path)
    assert hs.upsert_history(spark, path, frame([], SCHEMA), "year") == 1
    assert [rows(hs.read_history(spark, path, f)) for f in hs.FORMATS] == [[], []]
    assert hs.upsert_history(spark, path, frame(OLD, SCHEMA), "year") == 2
    assert hs.upsert_history(spark, path, frame([], SCHEMA), "year") == 2
    assert hs.upsert_history(spark, path, frame(NEW, SCHEMA), "year") == 3
    with pytest.raises(ValueError, match="partitioned"):
        hs.upsert_history(spark, path, frame(NEW, SCHEMA), "symbol")
    with pytest.raises(ValueError):
        hs.upsert_history(spark, path, frame(NEW, SCHEMA).drop("close"), "year")
    with pytest.raises(RuntimeError):
        hs._publish(spark, path, 3, {})
    hs.forget_versions(spark, path)
    assert hs.versions(spark, path) == [3]
    assert rows(hs.read_history(spark, path)) == merged() == rows(hs.read_history(spark, path, "csv"))
    assert not [p for p in (tmp_path / "h" / "parquet" / "version=2").iterdir() if p.name == "year=2021"]
