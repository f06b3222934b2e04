"""Cross-sectional statistics and ranks inside a group (a date).

A group may hold a large share of all rows. Statistics are aggregated (combined before the shuffle) and
joined back, by broadcast when they are small. Ranks sort a group in one task
only when the largest group is measured to be small; otherwise ties are counted first, each group is cut at
sampled values and the counts of the lower parts are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.scalar import clean
from barframe.plans.segments import as_list, longest_key

GROUP_ROWS = 1_000_000
RANK_CUTS = 64  # parts of a group at least; larger groups have one for each GROUP_ROWS rows
_GRAIN = 1 << 20


def with_group_stats(df: DataFrame, by: str | list[str], aggs: dict[str, Column]) -> DataFrame:
    """Join ``{name: aggregate}`` of each group back to its rows.

    Adaptive execution broadcasts the statistics when their measured size allows it. Settle ``df`` first when it
    is expensive: it is read twice.
    """
    by = as_list(by)
    return df.join(df.groupBy(*by).agg(*[a.alias(k) for k, a in aggs.items()]), by)


def zscore_column(
    value: Column, mean: Column, sd: Column, count: Column, min_finite: int = 2, on_too_few: str = "null"
) -> Column:
    few = F.lit(None).cast("double") if on_too_few == "null" else F.lit(0.0)
    return F.when(
        value.isNotNull(),
        F.when(count < min_finite, few).when(sd < 1e-12, F.lit(0.0)).otherwise((value - mean) / sd),
    )


def xs_zscore(
    df: DataFrame,
    columns: list[str],
    by: str | list[str] = "date",
    ddof: int = 0,
    min_finite: int = 2,
    on_too_few: str = "null",
    suffix: str = "_z",
) -> DataFrame:
    """Add ``{column}_z``: standard score among the finite values of the group.

    With fewer than ``min_finite`` values the score is NULL (``on_too_few='null'``) or 0 (``'zero'``).
    """
    if on_too_few not in ("null", "zero"):
        raise ValueError(f"on_too_few must be 'null' or 'zero', got {on_too_few}")
    if ddof not in (0, 1):
        raise ValueError(f"ddof must be 0 or 1, got {ddof}")
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs: dict[str, Column] = {}
    for c in columns:
        v = clean(c)
        aggs |= {f"_mu_{c}": F.avg(v), f"_sd_{c}": std(v), f"_ct_{c}": F.count(v)}
    out = with_group_stats(df, by, aggs)
    scores = {
        f"{c}{suffix}": zscore_column(
            clean(c), F.col(f"_mu_{c}"), F.col(f"_sd_{c}"), F.col(f"_ct_{c}"), min_finite, on_too_few
        )
        for c in columns
    }
    return out.withColumns(scores).drop(*aggs)


def _cut_values(values: DataFrame, by: list[str]) -> DataFrame:
    """Sorted sample values per group, in proportion to its size, chosen by the hash of the value.

    The choice depends on the data alone, so every part of a plan, and every retry, sees the same cuts.
    """
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    cuts = F.greatest(F.lit(RANK_CUTS), F.ceil(F.col("_size") / F.lit(float(GROUP_ROWS))))
    share = F.ceil(cuts * F.lit(_GRAIN) / F.col("_size"))
    chosen = values.join(sizes, by).filter(F.pmod(F.xxhash64(*by, "_value"), F.lit(_GRAIN)) < share)
    return chosen.groupBy(*by).agg(F.sort_array(F.collect_list("_value")).alias("_cuts"))


def with_rank_counts(
    df: DataFrame,
    value: str | Column,
    by: str | list[str] = "date",
    rows: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add ``_below`` (rows with a smaller value), ``_ties`` (rows with this value) and ``_count`` per group.

    Rows without a value get NULLs. Groups of up to ``rows`` rows are ranked by one window. In larger ones
    ties are counted before anything is sorted, so a value shared by most rows is one row from then on.
    Pass ``largest`` when the size of the largest group is known to save the count.
    """
    by = as_list(by)
    keyed = df.withColumn("_value", clean(value) if isinstance(value, str) else value)
    if (longest_key(df, by) if largest is None else largest) <= rows:
        group = Window.partitionBy(*by)
        up = group.orderBy(F.asc_nulls_last("_value"))
        known = F.col("_value").isNotNull()
        counts = {
            "_below": (F.rank().over(up) - 1).cast("long"),
            "_ties": F.count("_value").over(up.rangeBetween(Window.currentRow, Window.currentRow)),
            "_count": F.count("_value").over(group),
        }
        d = keyed.withColumns(counts)
        return d.select(*df.columns, *[F.when(known, F.col(c)).alias(c) for c in counts])
    ties = keyed.filter(F.col("_value").isNotNull()).groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_ties"))
    cuts = _cut_values(ties, by)
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_value")))
    placed = ties.join(cuts, by, "left").withColumn("_part", F.coalesce(part, F.lit(0))).drop("_cuts")

    totals = placed.groupBy(*by, "_part").agg(F.sum("_ties").alias("_sum"))
    lower = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_part",
        F.coalesce(F.sum("_sum").over(lower), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy(*by)).alias("_count"),
    )
    inside = Window.partitionBy(*by, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranks = (
        placed.withColumn("_inside", F.sum("_ties").over(inside) - F.col("_ties"))
        .join(offsets, [*by, "_part"])
        .select(*by, "_value", (F.col("_offset") + F.col("_inside")).alias("_below"), "_ties", "_count")
    )
    return keyed.join(ranks, [*by, "_value"], "left").drop("_value").select(*df.columns, "_below", "_ties", "_count")


def unit_rank_column(single: float = 0.5) -> Column:
    """Average rank of ties scaled to [0, 1] from the columns of :func:`with_rank_counts`."""
    below, ties, count = F.col("_below"), F.col("_ties"), F.col("_count")
    return F.when(count == 1, F.lit(float(single))).when(
        count > 1, (below + (ties - 1) / 2.0) / (count - 1).cast("double")
    )


def xs_rank(
    df: DataFrame,
    column: str,
    by: str | list[str] = "date",
    single: float = 0.5,
    out: str = "rank",
    rows: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Percentile rank in [0, 1] inside the group, ties averaged; a lone value gets ``single``."""
    ranked = with_rank_counts(df, column, by, rows, largest)
    return ranked.withColumn(out, unit_rank_column(single)).drop("_below", "_ties", "_count")


def top_n(df: DataFrame, n: int, by: str | list[str], score: str = "score", tie: str = "symbol") -> DataFrame:
    """The ``n`` best rows per group, best first; every task keeps at most ``n`` rows per group."""
    w = Window.partitionBy(*as_list(by)).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
