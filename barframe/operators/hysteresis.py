"""Labels that resist change: a small state machine per key, shared by batch and streaming.

A row proposes a label for each class of previous label (the raw classification depends on nothing else).
The machine's state is (label, days in it), and days beyond ``min_duration`` all behave alike, so there are
few states. A run of rows is then a map from state to state, which makes long keys divisible: the maps of
their segments are chained first and every segment is replayed from its known start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.plans import segments as sg

NONE = 0


@dataclass(frozen=True)
class Machine:
    """``labels`` in code order; ``klass[code]`` is the proposal column a previous label uses."""

    labels: tuple[str, ...]
    klass: tuple[int, ...]
    start_class: int
    n_classes: int
    min_duration: int
    gate: float
    instant: tuple[int, ...] = ()

    @property
    def n_states(self) -> int:
        return 1 + len(self.labels) * self.min_duration

    def state(self, label: int, days: int) -> int:
        return 1 + label * self.min_duration + min(days, self.min_duration) - 1

    def tables(self, raw: np.ndarray, conf: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row and state: next state, reported confidence, whether the label was newly entered."""
        n, m = len(raw), self.min_duration
        nxt = np.empty((n, self.n_states), dtype=np.int16)
        out = np.empty((n, self.n_states))
        new = np.zeros((n, self.n_states), dtype=bool)
        r, c = raw[:, self.start_class], conf[:, self.start_class]
        nxt[:, NONE], out[:, NONE], new[:, NONE] = 1 + r * m, c, True
        for label, klass in enumerate(self.klass):
            r, c = raw[:, klass], conf[:, klass]
            same = r == label
            at_once = np.isin(r, self.instant) & ~same
            for days in range(1, m + 1):
                s, stay = self.state(label, days), self.state(label, days + 1)
                early = ~same & ~at_once & (days < m)
                weak = ~same & ~at_once & ~early & (c < self.gate)
                switch = ~(same | early | weak)
                nxt[:, s] = np.where(switch, 1 + r * m, stay)
                out[:, s] = np.where(early, c * 0.5, c)
                new[:, s] = switch
        nxt[skip] = np.arange(self.n_states)
        new[skip] = False
        return nxt, out, new


def _arrays(pdf: pd.DataFrame, machine: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = range(machine.n_classes)
    raw = np.column_stack([pdf[f"raw_{i}"].to_numpy(dtype=np.int64) for i in k])
    conf = np.column_stack([pdf[f"conf_{i}"].to_numpy(dtype=float) for i in k])
    return raw, conf, pdf["skip"].to_numpy(dtype=bool)


def replay(
    pdf: pd.DataFrame, machine: Machine, state: int, days: int, since: int
) -> tuple[dict[str, np.ndarray], int, int, int]:
    """Run ordered rows (``at`` is their time as a number) from a known state.

    Returns label and raw label codes (-1 on skipped rows), confidences, days and start per row, then the end
    state. Only the label itself needs a loop; the other columns follow from where it was entered.
    """
    raw, conf, skip = _arrays(pdf, machine)
    live = np.flatnonzero(~skip)
    raw, conf, at = raw[live], conf[live], pdf["at"].to_numpy(dtype=np.int64)[live]
    m = len(live)
    label = -1 if state == NONE else (state - 1) // machine.min_duration
    run = days
    raw_rows, conf_rows, klass = raw.tolist(), conf.tolist(), machine.klass
    gate, least, instant = machine.gate, machine.min_duration, machine.instant
    labels, used, entered, early = [0] * m, [0] * m, [False] * m, [False] * m
    for i in range(m):
        k = machine.start_class if label < 0 else klass[label]
        new = raw_rows[i][k]
        used[i] = k
        if new == label:
            run += 1
        elif label < 0 or new in instant:
            label, run, entered[i] = new, 1, True
        elif run < least:
            run += 1
            early[i] = True
        elif conf_rows[i][k] < gate:
            run += 1
        else:
            label, run, entered[i] = new, 1, True
        labels[i] = label

    rows, col = np.arange(m), np.array(used, dtype=np.int64)
    own = conf[rows, col] if m else np.empty(0)
    last = np.maximum.accumulate(np.where(entered, rows, -1)) if m else rows
    began = last >= 0
    out = {
        "label": np.full(len(skip), -1, dtype=np.int32),
        "raw_label": np.full(len(skip), -1, dtype=np.int32),
        "confidence": np.full(len(skip), np.nan),
        "raw_confidence": np.full(len(skip), np.nan),
        "days_in_regime": np.zeros(len(skip), dtype=np.int64),
        "since": np.zeros(len(skip), dtype=np.int64),
    }
    if m:
        out["label"][live] = labels
        out["raw_label"][live] = raw[rows, col]
        out["confidence"][live] = np.where(early, own * 0.5, own)
        out["raw_confidence"][live] = own
        out["days_in_regime"][live] = np.where(began, rows - last + 1, days + rows + 1)
        out["since"][live] = np.where(began, at[last], since)
        days, since = int(out["days_in_regime"][live[-1]]), int(out["since"][live[-1]])
        state = machine.state(label, run)
    return out, state, days, since


def summarise(pdf: pd.DataFrame, machine: Machine) -> tuple[list[int], list[int], list[int], list[bool]]:
    """End state, days, start and whether a label was entered, for every possible state before the rows."""
    raw, conf, skip = _arrays(pdf, machine)
    nxt, _, new = machine.tables(raw, conf, skip)
    at = pdf["at"].to_numpy(dtype=np.int64)
    cur = np.arange(machine.n_states)
    days = np.zeros(machine.n_states, dtype=np.int64)
    where = np.full(machine.n_states, -1)
    for i in np.flatnonzero(~skip):
        fresh = new[i, cur]
        days = np.where(fresh, 1, days + 1)
        where = np.where(fresh, i, where)
        cur = nxt[i, cur]
    return cur.tolist(), days.tolist(), np.where(where >= 0, at[where], 0).tolist(), (where >= 0).tolist()


_OUT = T.StructType(
    [
        T.StructField("label", T.IntegerType()),
        T.StructField("raw_label", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("raw_confidence", T.DoubleType()),
        T.StructField("days_in_regime", T.LongType()),
        T.StructField("since", T.LongType()),
    ]
)


def as_number(kind: T.DataType, c: Column) -> Column:
    """A date or time as a whole number; Python tasks handle numbers, not date objects."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return c.cast("long")


def from_number(kind: T.DataType, c: Column) -> Column:
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(c.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(c)
    return c.cast(kind)


def named(df: DataFrame, machine: Machine, kind: T.DataType) -> DataFrame:
    """Turn codes and numbers back into labels and dates; skipped rows (code -1) become NULL."""
    names = F.array(*[F.lit(x) for x in machine.labels])
    ok = F.col("label") >= 0
    return df.withColumns(
        {
            "regime_start": F.when(ok, from_number(kind, F.col("since"))),
            "days_in_regime": F.when(ok, F.col("days_in_regime")),
            "confidence": F.when(ok, F.col("confidence")),
            "raw_confidence": F.when(ok, F.col("raw_confidence")),
            "raw_label": F.when(ok, F.get(names, F.col("raw_label"))),
            "label": F.when(ok, F.get(names, F.col("label"))),
        }
    ).drop("since")


def run(
    df: DataFrame,
    machine: Machine,
    by: str | list[str] = "symbol",
    order: str = "date",
    rows: int = sg.SEGMENT_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Fold the proposals ``raw_*``, ``conf_*``, ``skip`` of each key in ``order``; skipped rows get NULLs.

    Adds ``label, confidence, days_in_regime, raw_label, raw_confidence, regime_start``; proposals are dropped.
    """
    by = sg.as_list(by)
    kind = df.schema[order].dataType
    props = {"skip", *(f"{p}_{i}" for p in ("raw", "conf") for i in range(machine.n_classes))}
    kept = [c for c in df.columns if c not in props and c not in (*by, order)]
    src = df.select(*by, order, F.struct(*kept).alias("kept") if kept else F.lit(0).alias("kept"), *sorted(props))
    seg = sg.segment(src, by, order, rows=rows, longest=longest)
    d = seg.finish(seg.df).withColumn("at", as_number(kind, F.col(order))).drop(order, "n")
    if seg.split:
        d = d.join(_starts(d, machine, by), [*by, "_seg"], "left")

    plain = [f for f in d.schema.fields if f.name in (*by, "at", "kept")]
    names = [f.name for f in plain]
    schema = T.StructType([*plain, *_OUT.fields])

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        pdf = table.drop_columns(["kept"]).to_pandas()
        state, days, since = NONE, 0, 0
        if "_state" in pdf.columns and not pd.isna(pdf["_state"].iloc[0]):
            state, days, since = int(pdf["_state"].iloc[0]), int(pdf["_days"].iloc[0]), int(pdf["_since"].iloc[0])
        cols, *_ = replay(pdf, machine, state, days, since)
        out = table.select(names)
        for f in _OUT.fields:
            out = out.append_column(f.name, pa.array(cols[f.name]))
        return out

    done = named(d.groupBy(*seg.keys).applyInArrow(fold, schema), machine, kind)
    extra = [F.col(f"kept.{c}").alias(c) for c in kept]
    return done.select(*by, from_number(kind, F.col("at")).alias(order), *extra, "label", "confidence",
                       "days_in_regime", "raw_label", "raw_confidence", "regime_start")


def _starts(d: DataFrame, machine: Machine, by: list[str]) -> DataFrame:
    """State, days and start at the beginning of every later segment."""
    keys = [f for f in d.schema.fields if f.name in (*by, "_seg")]
    maps = T.StructType(
        [
            *keys,
            T.StructField("_end", T.ArrayType(T.IntegerType())),
            T.StructField("_run", T.ArrayType(T.LongType())),
            T.StructField("_at", T.ArrayType(T.LongType())),
            T.StructField("_new", T.ArrayType(T.BooleanType())),
        ]
    )

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        end, ran, at, new = summarise(pdf.sort_values("at", kind="stable"), machine)
        row = {k: [pdf[k].iloc[0]] for k in (*by, "_seg")}
        return pd.DataFrame({**row, "_end": [end], "_run": [ran], "_at": [at], "_new": [new]})

    chained = T.StructType(
        [
            *keys,
            T.StructField("_state", T.IntegerType()),
            T.StructField("_days", T.LongType()),
            T.StructField("_since", T.LongType()),
        ]
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seg")
        state, days, since, rows_out = NONE, 0, 0, []
        for seg, end, ran, at, new in zip(pdf["_seg"], pdf["_end"], pdf["_run"], pdf["_at"], pdf["_new"]):
            days = int(ran[state]) if new[state] else days + int(ran[state])
            since = int(at[state]) if new[state] else since
            state = int(end[state])
            rows_out.append((seg + 1, state, days, since))
        res = pd.DataFrame(rows_out, columns=["_seg", "_state", "_days", "_since"])
        for k in by:
            res[k] = pdf[k].iloc[0]
        return res[[f.name for f in chained.fields]]

    needed = d.filter("_more").drop("kept")
    done = needed.groupBy(*by, "_seg", "_more").applyInPandas(summary, maps)
    return done.groupBy(*by).applyInPandas(chain, chained)
