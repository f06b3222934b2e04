"""Cross-sectional alpha models, their blend by market regime and routing by stock regime.

Models are kept side by side in one row per (date, symbol), so blending them is arithmetic: no shuffle. The
long form (one row per model) goes through the same weights with one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.config import MARKET_LABELS, MODELS, ROUTE_WEIGHTS, STOCK_LABELS, AlphaConfig, RouterConfig
from barframe.functions.scalar import clamp01, keep_positive, literal_case, winsorize
from barframe.operators.cleaning import label_code
from barframe.operators.xsection import top_n, with_group_stats, xs_rank, zscore_column

LOWVOL_CONFIDENCE = 0.7
SIGNAL_INPUTS = {"momentum": ["mom63"], "meanrev": ["dev20", "rv20_z"], "lowvol": ["rv60", "rv20"]}


def signal(model: str) -> Column:
    """Raw signal a model scores across symbols; NULL marks missing data."""
    if model == "momentum":
        return F.col("mom63")
    if model == "meanrev":
        return -F.col("dev20")
    if model == "lowvol":
        return -F.coalesce("rv60", "rv20")
    raise ValueError(f"unknown model {model!r}")


def confidence(model: str, z: Column) -> Column:
    if model == "momentum":
        return clamp01(F.abs(z) / 3.0)
    if model == "meanrev":
        calm = clamp01(1.0 - F.greatest(F.lit(0.0), F.coalesce("rv20_z", F.lit(0.0))) / 2.0)
        return clamp01(F.abs("dev20") / 2.0) * calm
    if model == "lowvol":
        return F.when(z.isNotNull(), LOWVOL_CONFIDENCE)
    raise ValueError(f"unknown model {model!r}")


def reasons(model: str, z: Column) -> Column:
    """What the score was made of, as a map; missing data is flagged."""
    zero, one = F.lit(0.0), F.lit(1.0)
    if model == "momentum":
        known = {"mom63": F.col("mom63"), "z": z}
        blank = {"mom63": zero, "z": zero, "missing_data": one}
    elif model == "meanrev":
        known = {"dev20": F.col("dev20"), "rv20_z": F.coalesce("rv20_z", zero), "z": z}
        blank = {"dev20": zero, "rv20_z": zero, "z": zero, "missing_data": one}
    else:
        source = F.when(F.col("rv60").isNotNull(), 60.0).otherwise(20.0)
        known = {"rv_used": F.coalesce("rv60", "rv20"), "rv_source": source, "z": z}
        blank = {"rv_used": zero, "z": zero, "missing_data": one}

    def as_map(d: dict[str, Column]) -> Column:
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])

    return F.when(z.isNotNull(), as_map(known)).otherwise(as_map(blank))


def score_models(panel: DataFrame, models: tuple[str, ...] = MODELS, by: str = "date") -> DataFrame:
    """Add ``{model}_z`` (winsorized cross-sectional score, NULL if missing) and ``{model}_conf``.

    One aggregate per date serves all models.
    """
    aggs: dict[str, Column] = {}
    for m in models:
        s = signal(m)
        aggs |= {f"_mu_{m}": F.avg(s), f"_sd_{m}": F.stddev_pop(s), f"_ct_{m}": F.count(s)}
    d = with_group_stats(panel, by, aggs)
    zs = {
        f"{m}_z": winsorize(
            zscore_column(signal(m), F.col(f"_mu_{m}"), F.col(f"_sd_{m}"), F.col(f"_ct_{m}"), 2, "zero")
        )
        for m in models
    }
    d = d.withColumns(zs).drop(*aggs)
    return d.withColumns({f"{m}_conf": confidence(m, F.col(f"{m}_z")) for m in models})


def _one_model(panel: DataFrame, model: str) -> DataFrame:
    d = score_models(panel, (model,))
    z = F.col(f"{model}_z")
    return d.select(
        "date",
        "symbol",
        F.lit(model).alias("model"),
        F.coalesce(z, F.lit(0.0)).alias("score"),
        F.coalesce(z, F.lit(0.0)).alias("raw"),
        F.coalesce(f"{model}_conf", F.lit(0.0)).alias("confidence"),
        reasons(model, z).alias("reasons"),
    )


def momentum(panel: DataFrame) -> DataFrame:
    """z of the 63-day change; confidence grows with the size of the score."""
    return _one_model(panel, "momentum")


def meanrev(panel: DataFrame) -> DataFrame:
    """z of the negated deviation from the 20-day mean; confidence falls when volatility is high."""
    return _one_model(panel, "meanrev")


def lowvol(panel: DataFrame) -> DataFrame:
    """z of the negated 60-day volatility (20-day when missing); fixed confidence."""
    return _one_model(panel, "lowvol")


AlphaModel = Callable[[DataFrame], DataFrame]
BUILT_IN: dict[str, AlphaModel] = {"momentum": momentum, "meanrev": meanrev, "lowvol": lowvol}


def run_models(panel: DataFrame, extra: dict[str, AlphaModel] | None = None) -> DataFrame:
    """Long table of all model scores: one row per (date, symbol, model).

    ``extra`` holds further models: functions from the panel to ``date, symbol, score, raw, confidence``.
    """
    d = score_models(panel)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.coalesce(f"{m}_z", F.lit(0.0)).alias("score"),
                F.coalesce(f"{m}_z", F.lit(0.0)).alias("raw"),
                F.coalesce(f"{m}_conf", F.lit(0.0)).alias("confidence"),
            )
            for m in MODELS
        ]
    )
    out = d.select("date", "symbol", F.explode(rows).alias("m")).select("date", "symbol", "m.*")
    for name, fn in (extra or {}).items():
        out = out.unionByName(
            fn(panel).select("date", "symbol", F.lit(name).alias("model"), "score", "raw", "confidence")
        )
    return out


def _pair_case(table: dict[str, dict[str, float]], label: str, model: str, fixed: bool, default: float) -> str:
    """Weight by (label, model); ``model`` is a model's name when ``fixed``, else a column."""
    arms = []
    for name, weights in table.items():
        value = f"{float(weights.get(model, default))!r}d" if fixed else literal_case(model, weights, default)
        arms.append(f"when {label} = '{name}' then {value}")
    return f"case {' '.join(arms)} else {float(default)!r}d end"


def ensemble_weight(market_label: str, model: str, cfg: AlphaConfig, fixed: bool = False) -> Column:
    """Blend weight of a model under a market label; 0 for unlisted pairs. Labels and models are columns."""
    return F.expr(_pair_case(cfg.ensemble_weights, market_label, model, fixed, 0.0))


def route_weight(market_label: str, stock_label: str, model: str, cfg: RouterConfig, fixed: bool = False) -> Column:
    """Weight of a model under a stock label, damped in a stressed market.

    0 in labels the table leaves out, 1 for models it does not list.
    """
    table = {k: dict(v) for k, v in ROUTE_WEIGHTS.items()}
    table["range_low_vol"]["momentum"] = cfg.momentum_in_range_weight
    listed = ", ".join(f"'{k}'" for k in table)
    base = f"case when {stock_label} in ({listed}) then {_pair_case(table, stock_label, model, fixed, 1.0)} else 0.0d end"
    damp = f"{cfg.stress_market_weights.get(model, 1.0)!r}d" if fixed else literal_case(model, cfg.stress_market_weights, 1.0)
    return F.expr(f"({base}) * (case when {market_label} = 'stress' then {damp} else 1.0d end)")


def gate_reason(market_label: Column, stock_label: Column, cfg: RouterConfig) -> Column:
    """Why a symbol is held at zero, NULL when it is not."""
    return F.when(market_label == "crisis", "market_crisis").when(
        stock_label.isin(*cfg.gate_labels), F.concat(F.lit("stock_"), stock_label)
    )


def with_regimes(df: DataFrame, market: DataFrame, stock: DataFrame) -> DataFrame:
    """Add the market label of the date and the stock label and confidence of the symbol."""
    m = market.select("date", F.col("label").alias("market_label"))
    s = stock.select("date", "symbol", F.col("label").alias("stock_label"), F.col("confidence").alias("stock_conf"))
    return df.join(s, ["date", "symbol"]).join(m, "date")


def route(scores: DataFrame, market: DataFrame, stock: DataFrame, cfg: RouterConfig = RouterConfig()) -> DataFrame:
    """Combine long model scores into one non-negative score per (date, symbol).

    Every symbol with a stock regime gets a row. ``contributions`` maps each model to its share.
    """
    gate = gate_reason(F.col("market_label"), F.col("stock_label"), cfg)
    m = market.select("date", F.col("label").alias("market_label"))
    s = stock.select("date", "symbol", F.col("label").alias("stock_label"), F.col("confidence").alias("stock_conf"))
    d = s.join(m, "date").join(scores, ["date", "symbol"], "left")
    w = route_weight("market_label", "stock_label", "model", cfg)
    d = d.withColumn("w", F.when(gate.isNull() & F.col("model").isNotNull(), w).otherwise(0.0))
    d = d.withColumn("_wc", F.col("w") * F.col("confidence") * F.col("stock_conf"))
    d = d.withColumn("_contrib", F.when(F.col("w") > 0, keep_positive("score") * F.col("_wc")).otherwise(0.0))
    parts = F.collect_list(F.when(F.col("model").isNotNull(), F.struct("model", F.col("_contrib").alias("contrib"))))
    out = d.groupBy("date", "symbol").agg(
        F.first("market_label").alias("market_label"),
        F.first("stock_label").alias("stock_label"),
        F.first("stock_conf").alias("stock_conf"),
        F.sum("_contrib").alias("score"),
        F.sum(F.when(F.col("w") > 0, F.col("score") * F.col("_wc")).otherwise(0.0)).alias("raw"),
        F.sum(F.when(F.col("w") > 0, F.col("_wc")).otherwise(0.0)).alias("_num"),
        F.sum("w").alias("_den"),
        F.map_from_entries(parts).alias("contributions"),
    )
    conf = F.when(F.col("_den") > 0, clamp01(F.col("_num") / F.col("_den"))).otherwise(0.0)
    return out.select(
        "date", "symbol", "score", "raw", conf.alias("confidence"), "contributions", "market_label", "stock_label",
        "stock_conf", gate.alias("gate"),
    )


def weighted(scores: DataFrame, market: DataFrame, cfg: AlphaConfig = AlphaConfig()) -> DataFrame:
    """Scale long model scores by the ensemble weight of the date's market label."""
    m = market.select("date", F.col("label").alias("_ml"))
    w = ensemble_weight("_ml", "model", cfg)
    d = scores.join(m, "date").withColumn("ensemble_w", w)
    return d.withColumns({"score": F.col("score") * F.col("ensemble_w"), "raw": F.col("raw") * F.col("ensemble_w")}).drop("_ml")


def routing_table(spark: SparkSession, cfg: AlphaConfig = AlphaConfig(), models: tuple[str, ...] = MODELS) -> DataFrame:
    """Gate and weights of every (market label, stock label): ``w_`` routing, ``ew_`` ensemble weight per model.

    A constant table of twenty rows, so its join is planned as a broadcast from its known size.
    """
    pairs = ", ".join(f"('{m}', '{s}')" for m in MARKET_LABELS for s in STOCK_LABELS)
    d = spark.sql(f"SELECT * FROM VALUES {pairs} AS t(market_label, stock_label)")
    d = d.withColumn("gate", gate_reason(F.col("market_label"), F.col("stock_label"), cfg.router))
    cols: dict[str, Column] = {}
    for m in models:
        w = route_weight("market_label", "stock_label", m, cfg.router, True)
        cols[f"w_{m}"] = F.when(F.col("gate").isNull(), w).otherwise(0.0)
        cols[f"ew_{m}"] = ensemble_weight("market_label", m, cfg, True)
    return d.withColumns(cols)


def combine(d: DataFrame, cfg: AlphaConfig = AlphaConfig(), models: tuple[str, ...] = MODELS) -> DataFrame:
    """Blend and route the side-by-side scores of :func:`score_models` joined with :func:`with_regimes`."""
    table = routing_table(d.sparkSession, cfg, models)
    d = d.join(table, ["market_label", "stock_label"], "left")
    cols = {}
    for m in models:
        cols[f"w_{m}"] = f"coalesce(w_{m}, 0d)"
        cols[f"s_{m}"] = f"coalesce({m}_z, 0d) * coalesce(ew_{m}, 0d)"
        cols[f"g_{m}"] = f"coalesce({m}_conf, 0d) * stock_conf * coalesce(w_{m}, 0d)"
    d = d.withColumns({k: F.expr(v) for k, v in cols.items()})

    def total(term: str) -> str:
        return "(" + " + ".join(["0d", *(term.format(m=m) for m in models)]) + ")"

    d = d.withColumns(
        {
            **{f"contrib_{m}": F.expr(f"greatest(s_{m}, 0d) * g_{m}") for m in models},
            "raw": F.expr(total("s_{m} * g_{m}")),
            "_num": F.expr(total("g_{m}")),
            "_den": F.expr(total("w_{m}")),
        }
    )
    return d.withColumns(
        {
            "combined_score": F.expr(total("contrib_{m}")),
            "confidence": F.expr("case when _den > 0 then least(1d, greatest(0d, _num / _den)) else 0d end"),
        }
    ).drop("_num", "_den", *[f"{p}_{m}" for p in ("s", "g", "ew") for m in models])


def ensemble(
    panel: DataFrame, market: DataFrame, stock: DataFrame, cfg: AlphaConfig = AlphaConfig(), keep_parts: bool = False
) -> DataFrame:
    """Final score per (date, symbol): models, blend, routing, rank.

    Symbols held at zero are ranked too, so several of them share a rank above 0; ``gate_after_rank`` puts
    them back to 0.
    """
    return finish(combine(with_regimes(score_models(panel), market, stock), cfg), cfg, keep_parts)


def finish(
    d: DataFrame, cfg: AlphaConfig = AlphaConfig(), keep_parts: bool = False, largest: int | None = None
) -> DataFrame:
    """Rank the combined scores of :func:`combine` inside each date."""
    parts = [f"{p}_{m}" for m in MODELS for p in ("contrib", "w")] if keep_parts else []
    d = d.select("date", "symbol", "combined_score", "raw", "confidence", "market_label", "stock_label", "gate", *parts)
    if not cfg.normalize_to_ranks:
        return d.withColumn("score", F.col("combined_score"))
    ranked = xs_rank(d, "combined_score", "date", single=0.0, out="score", largest=largest)
    if cfg.gate_after_rank:
        ranked = ranked.withColumn("score", F.when(F.col("gate").isNotNull(), 0.0).otherwise(F.col("score")))
    return ranked


def attribution(df: DataFrame) -> DataFrame:
    """Contribution and weight of each model behind a score, one row per (date, symbol, model)."""
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(f"contrib_{m}").alias("contrib"), F.col(f"w_{m}").alias("weight"))
            for m in MODELS
        ]
    )
    return df.select("date", "symbol", F.explode(rows).alias("m")).select("date", "symbol", "m.*")


def with_label_codes(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"market_code": label_code("market_label"), "stock_code": label_code("stock_label")}
    )


def top_scores(df: DataFrame, n: int, by: str = "date") -> DataFrame:
    return top_n(df, n, by)
