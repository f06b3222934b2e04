"""Hysteresis labels over a stream of proposals, with the batch job's state machine and state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barframe.operators import hysteresis as hy
from barframe.streaming.state import require_rocksdb

BEFORE_ALL = -(2**62)
_STATE = T.StructType(
    [T.StructField("state", T.IntegerType()), T.StructField("days", T.LongType()), T.StructField("since", T.LongType()),
     T.StructField("last", T.LongType())]
)
_OUT = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("at", T.LongType()), *hy._OUT.fields])


class LabelProcessor(StatefulProcessor):
    """Keeps (state, days, since, last date) per symbol and replays the machine over each batch's ordered rows.

    A row on or before the last date is late or repeated: it would change labels already given, so it is left out. Of
    rows with one date in a batch the last counts.
    """

    def __init__(self, machine: hy.Machine) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable").reset_index(drop=True)
        state, days, since, last = self.kept.get() if self.kept.exists() else (hy.NONE, 0, 0, BEFORE_ALL)
        pdf = pdf[pdf["at"] > last].drop_duplicates("at", keep="last").reset_index(drop=True)
        if pdf.empty:
            return
        cols, *end = hy.replay(pdf, self.machine, state, days, since)
        self.kept.update((*(int(x) for x in end), int(pdf["at"].iloc[-1])))
        yield pd.DataFrame({"symbol": pdf["symbol"], "at": pdf["at"], **cols})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.kept.update((int(row["state"]), int(row["days"]), int(row["since"]), int(row["last"])))

    def close(self) -> None:
        pass


def last_states(labels: DataFrame, machine: hy.Machine) -> DataFrame:
    """State to continue from: the last label of each symbol in a batch result."""
    last = labels.filter(F.col("label").isNotNull()).groupBy("symbol").agg(
        F.max_by(F.struct("label", "days_in_regime", "regime_start"), "date").alias("l"), F.max("date").alias("_last")
    )
    code = F.array_position(F.array(*[F.lit(x) for x in machine.labels]), F.col("l.label")) - 1
    days = F.least(F.col("l.days_in_regime"), F.lit(machine.min_duration))
    return last.select(
        "symbol",
        (1 + code * machine.min_duration + days - 1).cast("int").alias("state"),
        F.col("l.days_in_regime").alias("days"),
        F.unix_date("l.regime_start").cast("long").alias("since"),
        F.unix_date("_last").cast("long").alias("last"),
    )


def stream_regime(proposals: DataFrame, machine: hy.Machine, start: DataFrame | None = None) -> DataFrame:
    """Labels of a stream of ``symbol, date, raw_*, conf_*, skip`` rows; needs the RocksDB state store.

    Rows on or before a symbol's last date are late or repeated and are left out. ``start`` (see
    :func:`last_states`) continues from a batch result. One symbol's state is a single small row.
    """
    require_rocksdb(proposals.sparkSession)
    kind = T.DateType()
    numbered = proposals.withColumn("at", hy.as_number(kind, F.col("date"))).drop("date")
    out = numbered.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=LabelProcessor(machine),
        outputStructType=_OUT,
        outputMode="append",
        timeMode="none",
        initialState=start.groupBy("symbol") if start is not None else None,
    )
    return hy.named(out, machine, kind).withColumn("date", hy.from_number(kind, F.col("at"))).drop("at")
