"""Long-only constrained weights from scores, per book (portfolio, date).

Selection keeps at most ``max_positions`` rows per book, and every task does so before the shuffle; all later
windows therefore run over groups of a known size, however wide the cross-section is.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.config import PortfolioConstraints
from barframe.functions.scalar import clamp01
from barframe.plans.segments import as_list
from barframe.plans.settle import new_path, release, settle

BOOK = ("portfolio_id", "date")
BATCH_DATES = 512


def candidates(scores: DataFrame, cons: PortfolioConstraints, universe: DataFrame | None = None) -> DataFrame:
    """Symbols of the universe scoring above the floor; a missing score counts as 0."""
    d = scores
    if universe is not None:
        d = d.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    return d.withColumn("score", F.coalesce("score", F.lit(0.0))).filter(F.col("score") > cons.score_floor)


def apply_risk(d: DataFrame, risk: DataFrame, cons: PortfolioConstraints, on: list[str] | None = None) -> DataFrame:
    """Scale scores by a per-symbol multiplier held in [0, 1] (1 when absent) and re-apply the floor."""
    on = on or [c for c in risk.columns if c != "multiplier"]
    m = clamp01(F.coalesce("multiplier", F.lit(1.0)))
    out = d.join(risk.select(*on, "multiplier"), on, "left").withColumn("score", F.col("score") * m)
    return out.drop("multiplier").filter(F.col("score") > cons.score_floor)


def select_positions(d: DataFrame, cons: PortfolioConstraints, by: str | list[str] | tuple[str, ...] = BOOK) -> DataFrame:
    """Best symbols per book by (score descending, symbol); ``position`` numbers them from 1."""
    by = as_list(by)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("symbol"))
    kept = d.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= cons.max_positions)
    if cons.selection_mode == "top_n":
        return kept
    sizes = settle(d.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")), "book-sizes")
    quota = F.greatest(F.lit(1), F.ceil(F.col("_size") * F.lit(cons.top_quantile)))
    return kept.join(sizes, by).filter(F.col("position") <= quota).drop("_size")


def raw_weights(d: DataFrame, cons: PortfolioConstraints, by: str | list[str] | tuple[str, ...] = BOOK) -> DataFrame:
    """Weights in proportion to positive scores; a short book with cash allowed gets a smaller target."""
    book = Window.partitionBy(*as_list(by))
    d = d.withColumns({"_n": F.count(F.lit(1)).over(book), "_pos": F.greatest("score", F.lit(0.0))})
    d = d.withColumn("_sum", F.sum("_pos").over(book))
    target = F.lit(float(cons.gross_target))
    if cons.allow_cash and cons.min_positions > 0:
        short = F.col("_n") < cons.min_positions
        target = F.when(short, target * F.col("_n") / float(cons.min_positions)).otherwise(target)
    weight = F.when(F.col("_sum") > 0, F.col("_pos") * (target / F.col("_sum"))).otherwise(0.0)
    return d.withColumn("weight", weight).drop("_n", "_pos", "_sum")


def cap_weights(
    d: DataFrame, cap: float | Column, by: str | list[str] | tuple[str, ...] = BOOK, weight: str = "weight"
) -> DataFrame:
    """Cap each weight and hand the excess to the uncapped ones in proportion, keeping the book's total.

    The repeated capping has a closed form, ``min(cap, s * w)``: going down the weights, the first one that
    fits below the cap after the larger ones are set to the cap fixes the scale ``s``. If none fits, every
    position sits at the cap and the book stays under its total.
    """
    if not isinstance(cap, Column):
        if not 0.0 < cap <= 1.0:
            raise ValueError(f"max_weight must be in (0, 1], got {cap}")
        cap = F.lit(float(cap))
    by = as_list(by)
    book = Window.partitionBy(*by)
    down = book.orderBy(F.desc(weight), F.asc("symbol"))
    d = d.withColumns(
        {
            "_rank": F.row_number().over(down),
            "_total": F.sum(weight).over(book),
            "_rest": F.sum(weight).over(down.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    scale = F.when(F.col("_rest") > 0, (F.col("_total") - (F.col("_rank") - 1) * cap) / F.col("_rest"))
    d = d.withColumn("_scale", scale)
    d = d.withColumn("_fits", F.when(F.col(weight) * F.col("_scale") <= cap, F.struct("_rank", "_scale")))
    d = d.withColumn("_first", F.min("_fits").over(book))
    w, first = F.col(weight), F.col("_first")
    capped = (
        F.when((F.col("_total") <= 0) | (w <= 0), w)
        .when(first.isNull() | (F.col("_rank") < first["_rank"]), cap)
        .when(first["_rank"] == 1, w)
        .otherwise(w * first["_scale"])
    )
    return d.withColumn(weight, capped).drop("_rank", "_total", "_rest", "_scale", "_fits", "_first")


def apply_max_weight(d: DataFrame, cons: PortfolioConstraints, by: str | list[str] | tuple[str, ...] = BOOK) -> DataFrame:
    """Cap, and when cash is not allowed scale a book that fell short back up and cap again."""
    out = cap_weights(d, cons.max_weight, by)
    if cons.allow_cash:
        return out
    book = Window.partitionBy(*as_list(by))
    out = out.withColumn("_sum", F.sum("weight").over(book))
    short = (F.col("_sum") > 0) & (F.col("_sum") < cons.gross_target - 1e-12)
    scaled = F.when(short, F.col("weight") * (cons.gross_target / F.col("_sum"))).otherwise(F.col("weight"))
    return cap_weights(out.withColumn("weight", scaled).drop("_sum"), cons.max_weight, by)


def apply_min_weight(d: DataFrame, cons: PortfolioConstraints, by: str | list[str] | tuple[str, ...] = BOOK) -> DataFrame:
    """Drop positions below the floor, spread their weight over the others and cap again."""
    if cons.min_weight <= 0.0:
        return d
    book = Window.partitionBy(*as_list(by))
    keep = F.col("weight") >= cons.min_weight
    d = d.withColumns(
        {"_all": F.sum("weight").over(book), "_kept": F.sum(F.when(keep, F.col("weight"))).over(book)}
    ).filter(keep)
    freed = F.col("_all") - F.col("_kept")
    scaled = F.when(freed > 0, F.col("weight") * (F.col("_all") / F.col("_kept"))).otherwise(F.col("weight"))
    return cap_weights(d.withColumn("weight", scaled).drop("_all", "_kept"), cons.max_weight, by)


def target_weights(
    scores: DataFrame,
    cons: PortfolioConstraints,
    by: str | list[str] | tuple[str, ...] = BOOK,
    universe: DataFrame | None = None,
    risk: DataFrame | None = None,
) -> DataFrame:
    """Targets before any trading limit: floor, risk, selection, proportional weights, cap, minimum weight."""
    d = candidates(scores, cons, universe)
    if risk is not None:
        d = apply_risk(d, risk, cons)
    d = raw_weights(select_positions(d, cons, by), cons, by)
    d = apply_min_weight(apply_max_weight(d, cons, by), cons, by)
    return d.select(*as_list(by), "symbol", "score", "weight")


def _both(new: DataFrame, old: DataFrame, by: list[str]) -> DataFrame:
    n = new.select(*by, "symbol", F.col("weight").alias("w_new"))
    o = old.select(*by, "symbol", F.col("weight").alias("w_old"))
    zero = F.lit(0.0)
    return n.join(o, [*by, "symbol"], "full_outer").withColumns(
        {"w_new": F.coalesce("w_new", zero), "w_old": F.coalesce("w_old", zero)}
    )


def turnover(new: DataFrame, old: DataFrame, by: str | list[str] | tuple[str, ...] = BOOK) -> DataFrame:
    """Sum of absolute weight changes per book; an absent weight is 0."""
    by = as_list(by)
    return _both(new, old, by).groupBy(*by).agg(F.sum(F.abs(F.col("w_new") - F.col("w_old"))).alias("turnover"))


def apply_band(
    new: DataFrame, old: DataFrame, cons: PortfolioConstraints, by: str | list[str] | tuple[str, ...] = BOOK
) -> DataFrame:
    """Keep the old weight where the change is smaller than the band; entries and exits always trade."""
    by = as_list(by)
    n = new.select(*by, "symbol", F.col("weight").alias("w_new"))
    o = old.select(*by, "symbol", F.col("weight").alias("w_old"))
    d = n.join(o, [*by, "symbol"], "left").withColumn("w_old", F.coalesce("w_old", F.lit(0.0)))
    hold = (F.col("w_old") != 0) & (F.col("w_new") != 0) & (F.abs(F.col("w_new") - F.col("w_old")) < cons.rebalance_band)
    book = Window.partitionBy(*by)
    d = d.withColumn("weight", F.when(hold, F.col("w_old")).otherwise(F.col("w_new")))
    d = d.withColumn("_sum", F.sum("weight").over(book))
    scaled = F.col("weight") * (F.least(F.lit(float(cons.gross_target)), F.col("_sum")) / F.col("_sum"))
    d = d.withColumn("weight", F.when(F.col("_sum") > 0, scaled).otherwise(F.col("weight")))
    return cap_weights(d.select(*by, "symbol", "weight"), cons.max_weight, by)


def apply_turnover_limit(
    new: DataFrame, old: DataFrame, cons: PortfolioConstraints, by: str | list[str] | tuple[str, ...] = BOOK
) -> DataFrame:
    """Move only part of the way to the new weights when the turnover limit would be passed."""
    by = as_list(by)
    if cons.turnover_limit is None:
        return new.select(*by, "symbol", "weight")
    d = _both(new, old, by)
    book = Window.partitionBy(*by)
    d = d.withColumn("_t", F.sum(F.abs(F.col("w_new") - F.col("w_old"))).over(book))
    limit = float(cons.turnover_limit)
    over = F.col("_t") > limit
    moved = F.greatest(F.col("w_old") + (limit / F.col("_t")) * (F.col("w_new") - F.col("w_old")), F.lit(0.0))
    d = d.withColumn("weight", F.when(over, moved).otherwise(F.col("w_new"))).filter(
        (F.col("weight") > 0) | (~over & (F.col("w_new") > 0))
    )
    capped = cap_weights(d.select(*by, "symbol", "weight", over.alias("_over")).withColumn("_plain", F.col("weight")),
                         cons.max_weight, by)
    out = F.when(F.col("_over"), F.col("weight")).otherwise(F.col("_plain"))
    return capped.withColumn("weight", out).select(*by, "symbol", "weight")


# One book's weights by symbol (at most ``max_positions``), for the path over dates where every day starts from the day before.
def _added(values: Iterable[float]) -> float:
    """Left to right in plain doubles. ``sum`` compensates rounding from Python 3.12 on, so a turnover that meets its limit exactly (a
    limited move taken back the day after) would pass it or not by the interpreter."""
    return reduce(add, values, 0.0)


def _cap_book(book: dict[str, float], cap: float) -> dict[str, float]:
    total = _added(book.values())
    if total <= 0:
        return book
    down = sorted((s for s in book if book[s] > 0), key=lambda s: (-book[s], s))
    for k, s in enumerate(down):
        scale = (total - k * cap) / _added(book[t] for t in down[k:])
        if book[s] * scale <= cap:
            larger = set(down[:k])
            return {t: cap if t in larger else w * scale for t, w in book.items()} if k else book
    return {t: cap if w > 0 else w for t, w in book.items()}


def step_weights(target: dict[str, float], held: dict[str, float], cons: PortfolioConstraints) -> dict[str, float]:
    """Weights after the band and the turnover limit, given today's targets and the weights held."""
    book = target
    if not held:
        return book
    if cons.rebalance_band > 0.0:
        old = {s: held.get(s, 0.0) for s in book}
        book = {s: old[s] if old[s] != 0 and w != 0 and abs(w - old[s]) < cons.rebalance_band else w for s, w in book.items()}
        total = _added(book.values())
        if total > 0:
            scale = min(cons.gross_target, total) / total
            book = _cap_book({s: max(w, 0.0) * scale for s, w in book.items()}, cons.max_weight)
    if cons.turnover_limit is not None:
        change = {s: book.get(s, 0.0) - held.get(s, 0.0) for s in sorted({*book, *held})}
        traded = _added(abs(c) for c in change.values())
        if traded > cons.turnover_limit and traded > 0:
            share = cons.turnover_limit / traded
            moved = {s: max(held.get(s, 0.0) + share * c, 0.0) for s, c in change.items()}
            book = _cap_book({s: w for s, w in moved.items() if w > 0}, cons.max_weight)
    return book


def _done(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def rebalance_path(targets: DataFrame, dates: DataFrame, cons: PortfolioConstraints, batch: int = BATCH_DATES, folder: str | None = None) -> DataFrame:
    """Band and turnover limit along the dates of each portfolio.

    Each day's weights depend on the whole book of the day before, so dates are scanned in order, ``batch`` of them at a time:
    the targets are written once by batch, and a step reads its own batch and the last book of the step before, a small table. A
    task holds one portfolio's batch, at most ``batch * max_positions`` rows, however long the history is. Every step writes its weights
    under ``folder`` (a new one in the shared folder if it is not given); steps already finished there are not run again.
    ``dates`` has the rebalance dates per portfolio, so a date without targets empties the book.
    """
    spark = targets.sparkSession
    folder = folder or new_path(spark, "weight-path")
    order = Window.partitionBy("portfolio_id").orderBy("date")  # one row per rebalance date
    days = dates.select("portfolio_id", "date").distinct().withColumn("_batch", F.expr(f"(row_number() over (partition by portfolio_id order by date) - 1) div {batch}"))
    days = days.withColumn("_last", F.lead("_batch").over(order).isNull() | (F.lead("_batch").over(order) > F.col("_batch")))
    days = settle(days, "path-days")
    steps = (days.agg(F.max("_batch")).first()[0] or 0) + 1
    rows = days.join(targets.select("portfolio_id", "date", "symbol", "weight"), ["portfolio_id", "date"], "left")
    rows = settle(rows, "path-targets", ["_batch"])
    kinds = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([kinds["portfolio_id"], kinds["date"], kinds["symbol"], T.StructField("weight", T.DoubleType()), T.StructField("_last", T.BooleanType())])

    def fold(targets: pd.DataFrame, book: pd.DataFrame) -> pd.DataFrame:
        held, out = dict(zip(book["symbol"], book["weight"], strict=True)), []
        for day, own in targets.sort_values(["date", "symbol"]).groupby("date", sort=True):
            known = own[own["symbol"].notna()]
            held = step_weights(dict(zip(known["symbol"], known["weight"], strict=True)), held, cons)
            last = bool(own["_last"].iloc[0])
            out += [(own["portfolio_id"].iloc[0], day, s, w, last) for s, w in held.items()]
        return pd.DataFrame(out, columns=schema.names)

    book = spark.createDataFrame([], schema)
    for k in range(steps):
        path = f"{folder}/batch={k}"
        if not _done(spark, path):
            part = rows.filter(F.col("_batch") == k).drop("_batch").groupBy("portfolio_id")
            part.cogroup(book.groupBy("portfolio_id")).applyInPandas(fold, schema).write.mode("overwrite").parquet(path)
        book = spark.read.schema(schema).parquet(path).filter("_last")
    release(days, rows, sweep=False)
    return spark.read.schema(schema).parquet(*[f"{folder}/batch={k}" for k in range(steps)]).drop("_last")


def diagnostics(
    weights: DataFrame,
    n_candidates: DataFrame,
    cons: PortfolioConstraints,
    traded: DataFrame | None = None,
    by: str | list[str] | tuple[str, ...] = BOOK,
) -> DataFrame:
    """Selected and dropped counts, gross target, cash and (when given) turnover per book."""
    by = as_list(by)
    held = weights.groupBy(*by).agg(F.count_if(F.col("weight") > 0).alias("selected"), F.sum("weight").alias("gross"))
    d = n_candidates.join(held, by, "left").withColumns(
        {"selected": F.coalesce("selected", F.lit(0)), "gross": F.coalesce("gross", F.lit(0.0))}
    )
    d = d.withColumns(
        {
            "dropped": F.col("candidates") - F.col("selected"),
            "gross_target": F.lit(float(cons.gross_target)),
            "cash_weight": F.greatest(F.lit(0.0), F.lit(float(cons.gross_target)) - F.col("gross")),
        }
    )
    if traded is not None:
        d = d.join(traded, by, "left")
    return d


def views(weights: DataFrame, by: str | list[str] | tuple[str, ...] = BOOK) -> DataFrame:
    """Position count, largest weight, gross, cash and the symbols by weight, per book."""
    held = F.sort_array(F.collect_list(F.when(F.col("weight") > 0, F.struct((-F.col("weight")).alias("k"), "symbol"))))
    return weights.groupBy(*as_list(by)).agg(
        F.count_if(F.col("weight") > 0).alias("n_positions"),
        F.max("weight").alias("max_weight"),
        F.sum("weight").alias("gross"),
        F.greatest(F.lit(0.0), 1.0 - F.sum("weight")).alias("cash"),
        held["symbol"].alias("symbols"),
    )


def clip_long_only(weights: DataFrame, by: str | list[str] | tuple[str, ...] = BOOK) -> DataFrame:
    """Drop negative weights; a book that had any keeps its positive gross."""
    by = as_list(by)
    # The positive weights already sum to the positive gross, so dropping the others leaves nothing to scale.
    lowest = weights.groupBy(*by).agg(F.min("weight").alias("_low"))
    return weights.join(lowest, by).filter((F.col("weight") > 0) | (F.col("_low") >= 0)).drop("_low")


def universe_cap(members: DataFrame, by: str | list[str] | tuple[str, ...] = ("portfolio_id",)) -> DataFrame:
    """Weight cap, position bounds scaled to the number of symbols of each portfolio."""
    n = F.col("n_symbols")
    return members.groupBy(*as_list(by)).agg(F.count_distinct("symbol").alias("n_symbols")).withColumns(
        {
            "max_weight": F.least(F.lit(0.25), F.greatest(F.lit(0.05), F.round(F.lit(2.0) / n, 4))),
            "max_positions": F.least(F.lit(50), n).cast("long"),
            "min_positions": F.least(F.lit(5), n).cast("long"),
        }
    )


def trades(
    new: DataFrame, old: DataFrame, prices: DataFrame, nav: float, by: str | list[str] | tuple[str, ...] = BOOK
) -> DataFrame:
    """Orders that turn the old weights into the new ones at the given prices; ``qty`` is NULL where there is no price."""
    by = as_list(by)
    d = _both(new, old, by).withColumn("delta", F.col("w_new") - F.col("w_old")).filter(F.col("delta") != 0)
    d = d.join(prices.select("symbol", "price"), "symbol", "left")
    return d.select(
        *by,
        "symbol",
        F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"),
        F.abs(F.col("delta") * F.lit(float(nav)) / F.col("price")).alias("qty"),
        "delta",
    )
