"""Next-day labels, walk-forward folds, logistic regression per fold and its metrics."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barframe.operators.cleaning import drop_incomplete, select_features
from barframe.operators.xsection import with_rank_counts
from barframe.plans.segments import segment
from barframe.plans.settle import new_path, settle

CLIP = 1e-12
FITS_AT_ONCE = 4


def next_day_label(
    df: DataFrame, label_mode: str = "forward", by: str = "symbol", order: str = "date", close: str = "close"
) -> DataFrame:
    """Add ``ret_fwd_1`` and ``y``.

    ``forward``: y is 1 when the next close is higher; the last row of a symbol has no label and is dropped.
    ``compat``: the change is measured from the next close back to this one, so y is 1 before a fall, and the
    last row gets 0.
    """
    if label_mode not in ("forward", "compat"):
        raise ValueError(f"label_mode must be 'forward' or 'compat', got {label_mode}")
    if close not in df.columns:
        raise ValueError(f"missing columns: ['{close}']")
    seg = segment(df.drop("n"), by, order, after=1)
    d = seg.finish(seg.df.withColumn("_next", F.lead(close).over(seg.window(order))))
    a, b = F.col("_next"), F.col(close)
    change = F.when(b != 0, a / b - 1) if label_mode == "forward" else F.when(a != 0, b / a - 1)
    d = d.withColumn("ret_fwd_1", change).withColumn("y", F.coalesce(F.col("ret_fwd_1") > 0, F.lit(False)).cast("int"))
    cols = [c for c in df.columns if c != "n"]
    out = d.select(*cols, "ret_fwd_1", "y")
    return out.filter(F.col("ret_fwd_1").isNotNull()) if label_mode == "forward" else out


def walk_forward(
    df: DataFrame,
    train: int = 504,
    test: int = 21,
    step: int | None = None,
    gap: int = 0,
    anchored: bool = True,
    date: str = "date",
) -> DataFrame:
    """One row per fold with the first and last date of its train and test spans.

    Spans count distinct dates. The last fold may end on the last date. Too few dates raise ``ValueError``.
    """
    step = step or test
    idx = Window.orderBy(date)  # one row per calendar day
    days = settle(
        df.select(date).filter(F.col(date).isNotNull()).distinct().withColumn("idx", F.row_number().over(idx) - 1),
        "fold-days",
    )
    n = days.count()
    need = train + gap + test
    if n < need:
        raise ValueError(f"Not enough unique dates ({n}) for train_days={train}, gap_days={gap}, test_days={test}")
    folds = df.sparkSession.range(0, (n - need) // step + 1).select((F.col("id") + 1).alias("fold"), (F.col("id") * step).alias("_s"))
    first = F.lit(0) if anchored else F.col("_s")
    edges = {
        "train_start": first,
        "train_end": F.col("_s") + train - 1,
        "test_start": F.col("_s") + train + gap,
        "test_end": F.col("_s") + need - 1,
    }
    out = folds.withColumns({f"_{k}": c.cast("int") for k, c in edges.items()})
    for k in edges:
        day = days.select(F.col("idx").cast("int").alias(f"_{k}"), F.col(date).alias(k))
        out = out.join(day, f"_{k}")
    return out.select("fold", *edges)


def fold_roles(folds: DataFrame, days: DataFrame, date: str = "date") -> DataFrame:
    """(fold, role, date): each fold's span of days cut down to the trading dates."""
    spans = [
        folds.select(
            "fold", F.lit(role).alias("role"), F.explode(F.sequence(f"{role}_start", f"{role}_end")).alias(date)
        )
        for role in ("train", "test")
    ]
    return spans[0].unionByName(spans[1]).join(days.select(date).distinct(), date, "left_semi")


def training_table(
    df: DataFrame,
    features: list[str],
    keep: tuple[str, ...] = ("symbol", "date", "close"),
    label_mode: str = "forward",
) -> DataFrame:
    """Chosen columns, label, rows with all features: the table the folds are cut from."""
    d = next_day_label(select_features(df, features, keep), label_mode)
    return drop_incomplete(d, [*features, "y"])


def standardize_fit(train: DataFrame, features: list[str], by: str | None = None) -> DataFrame:
    """Mean and population deviation of each feature (1 where it is 0): one aggregate, a few numbers."""
    aggs: list[Column] = []
    for f in features:
        sd = F.stddev_pop(f)
        aggs += [F.avg(f).alias(f"mean_{f}"), F.when(sd > 0, sd).otherwise(1.0).alias(f"sd_{f}")]
    return (train.groupBy(by) if by else train.groupBy()).agg(*aggs)


def date_moments(table: DataFrame, features: list[str], date: str = "date", y: str = "y") -> DataFrame:
    """Rows, rows with label 1, and each feature's mean and squared deviations, by date: what spans of dates are merged from."""
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(F.col(y) == 1).alias("_n1")]
    for f in features:
        aggs += [F.avg(f).alias(f"_m_{f}"), (F.var_pop(f) * F.count(f)).alias(f"_q_{f}")]
    return table.groupBy(date).agg(*aggs)


def standardize_by_fold(table: DataFrame, folds: DataFrame, features: list[str], date: str = "date") -> DataFrame:
    """(fold, n, n1, mean_*, sd_*) of every fold's train span, the rows read once whatever the number of folds.

    Rows become moments by date first; a fold merges the moments of its dates, which are as few as the calendar's days.
    """
    days = settle(date_moments(table, features, date), "date-moments")
    span = days.join(folds.select("fold", "train_start", "train_end"), F.col(date).between(F.col("train_start"), F.col("train_end")))
    fold = Window.partitionBy("fold")
    d = span.withColumns({f"mean_{f}": F.sum(F.col(f"_m_{f}") * F.col("_n")).over(fold) / F.sum("_n").over(fold) for f in features})
    aggs = [F.sum("_n").alias("n"), F.sum("_n1").alias("n1")]
    for f in features:
        mean = F.col(f"mean_{f}")
        sd = F.sqrt(F.sum(F.col(f"_q_{f}") + F.col("_n") * (F.col(f"_m_{f}") - mean) * (F.col(f"_m_{f}") - mean)) / F.sum("_n"))
        aggs += [F.max(mean).alias(f"mean_{f}"), F.when(sd > 0, sd).otherwise(1.0).alias(f"sd_{f}")]
    return d.groupBy("fold").agg(*aggs)


def standardize_apply(df: DataFrame, fitted: dict[str, float], features: list[str]) -> DataFrame:
    return df.withColumns(
        {f: (F.col(f) - F.lit(fitted[f"mean_{f}"])) / F.lit(fitted[f"sd_{f}"]) for f in features}
    )


@dataclass(frozen=True)
class ModelMeta:
    model_name: str
    feature_cols: list[str]
    created_utc: str
    extra: dict = field(default_factory=dict)


def _quadratic_step(b: np.ndarray, gradient: np.ndarray, gram: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The minimum of the loss's quadratic model plus the penalty; the first coefficient (intercept) is not penalised."""
    ridge = np.full(len(b), l2)
    ridge[0] = 0.0
    h = gram + np.diag(ridge)
    if l1 == 0:
        return b + np.linalg.lstsq(h, gradient - ridge * b, rcond=None)[0]
    x, pull = b.copy(), gradient + gram @ b
    for _ in range(10_000):  # coordinate descent on a few numbers
        before = x.copy()
        for j in range(len(x)):
            rest = pull[j] - h[j] @ x + h[j, j] * x[j]
            x[j] = (rest if j == 0 else np.sign(rest) * max(abs(rest) - l1, 0.0)) / max(h[j, j], 1e-300)
        if np.abs(x - before).max() <= 1e-13 * max(1.0, np.abs(x).max()):
            break
    return x


def _fold_sums(data: DataFrame, features: list[str], spans: list[tuple], at: list[np.ndarray], date: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Gram matrix of every span at its coefficients: one pass, one aggregate.

    ``spans`` are (first day, last day, means, deviations, weight of label 0, of label 1). A task adds up its batches and emits one
    row per span; the sums over tasks come to the driver, ``len(spans) * (width + 1) ** 2`` numbers at most.
    """
    width = len(features) + 1

    def sums(batches):
        total = np.zeros((len(spans), 1 + width + width * width))
        for batch in batches:
            day = batch.column("day").to_numpy()
            y = batch.column("y").to_numpy().astype(np.float64)
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1) if features else np.empty((len(y), 0))
            for k, (first, last, mean, sd, w0, w1) in enumerate(spans):
                own = (day >= first) & (day <= last)
                if not own.any():
                    continue
                z = np.column_stack([np.ones(own.sum()), (x[own] - mean) / sd])
                t, eta = y[own], z @ at[k]
                w = np.where(t == 1, w1, w0)
                p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                loss = w * (np.logaddexp(0, eta) - t * eta)
                total[k] += np.concatenate([[loss.sum()], z.T @ (w * (t - p)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(spans))), pa.array(list(total), pa.list_(pa.float64()))], names=["span", "sums"])

    rows = data.select(F.unix_date(date).alias("day"), F.col("y").cast("int").alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    parts = rows.mapInArrow(sums, "span long, sums array<double>").select("span", F.posexplode("sums").alias("i", "v"))
    got = parts.groupBy("span", "i").agg(F.sum("v").alias("v")).groupBy("span").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("s")).collect()
    out = {}
    for r in got:
        s = np.array(r["s"])
        out[r["span"]] = (s[0], s[1 : 1 + width], s[1 + width :].reshape(width, width))
    return out


@dataclass
class ScaledLogistic:
    """Standardised logistic regression with inverse strength ``C`` and an l1, l2 or elastic-net penalty.

    Fitted by Newton steps: an iteration is one aggregate over the rows, of the gradients and Gram matrices of all spans that have not
    converged; the steps themselves are a few numbers in the driver. A step that raises the penalised loss is halved.
    """

    features: list[str]
    C: float = 1.0
    penalty: str = "l2"
    l1_ratio: float = 0.5
    max_iter: int = 2000
    tol: float = 1e-9
    class_weight: dict[int, float] | str | None = None
    scale: dict[str, float] | None = None
    intercept: float | None = None
    coefficients: list[float] | None = None
    meta: ModelMeta | None = None

    def _mix(self) -> float:
        mixes = {"l2": 0.0, "l1": 1.0, "elasticnet": self.l1_ratio}
        if self.penalty not in mixes:
            raise ValueError(f"unknown penalty {self.penalty}")
        return mixes[self.penalty]

    def _weights(self, n0: int, n1: int) -> dict[int, float]:
        if self.class_weight is None:
            return {0: 1.0, 1: 1.0}
        if self.class_weight == "balanced":
            n = n0 + n1
            return {0: n / (2.0 * max(n0, 1)), 1: n / (2.0 * max(n1, 1))}
        return {0: float(self.class_weight.get(0, 1.0)), 1: float(self.class_weight.get(1, 1.0))}

    def fit(self, train: DataFrame, date: str = "date") -> "ScaledLogistic":
        """Fit on all rows of ``train``."""
        first, last = train.agg(F.min(date), F.max(date)).first()
        if first is None:
            raise ValueError("no rows to fit")
        kind = train.schema[date].dataType.simpleString()
        whole = train.sparkSession.createDataFrame([(1, first, last)], f"fold long, train_start {kind}, train_end {kind}")
        (fitted,) = self.fit_folds(train, whole, date).values()
        self.scale, self.intercept, self.coefficients, self.meta = fitted.scale, fitted.intercept, fitted.coefficients, fitted.meta
        return self

    def fit_folds(self, table: DataFrame, folds: DataFrame, date: str = "date") -> dict[int, "ScaledLogistic"]:
        """One fitted model per fold, all folds together. ``table`` is read once per iteration."""
        mix = self._mix()
        l1, l2 = mix / self.C, (1.0 - mix) / self.C
        facts = standardize_by_fold(table, folds, self.features, date).join(folds.select("fold", F.unix_date("train_start").alias("_a"), F.unix_date("train_end").alias("_b")), "fold")
        models, spans = [], []
        for r in sorted(facts.collect(), key=lambda r: r["fold"]):
            scale = {k: float(r[k]) for f in self.features for k in (f"mean_{f}", f"sd_{f}")}
            w = self._weights(r["n"] - r["n1"], r["n1"])
            models.append((r["fold"], scale))
            spans.append((r["_a"], r["_b"], np.array([scale[f"mean_{f}"] for f in self.features]), np.array([scale[f"sd_{f}"] for f in self.features]), w[0], w[1]))
        width = len(self.features) + 1
        done = [np.zeros(width) for _ in spans]
        trial, best, open_ = list(done), [np.inf] * len(spans), list(range(len(spans)))
        for _ in range(self.max_iter):
            if not open_:
                break
            got = _fold_sums(table, self.features, [spans[k] for k in open_], [trial[k] for k in open_], date)
            still = []
            for i, k in enumerate(open_):
                loss, gradient, gram = got[i]
                b = trial[k]
                value = loss + l1 * np.abs(b[1:]).sum() + l2 / 2 * (b[1:] @ b[1:])
                if value > best[k] + 1e-9 * abs(best[k]):
                    trial[k] = (done[k] + b) / 2
                else:
                    done[k], best[k] = b, value
                    trial[k] = _quadratic_step(b, gradient, gram, l1, l2)
                if np.abs(trial[k] - done[k]).max() > self.tol:
                    still.append(k)
                else:
                    done[k] = trial[k]
            open_ = still
        stamp = datetime.now(timezone.utc).replace(microsecond=0).isoformat().replace("+00:00", "Z")
        extra = {"C": self.C, "penalty": self.penalty, "max_iter": self.max_iter, "class_weight": self.class_weight}
        meta = ModelMeta("logistic_regression", list(self.features), stamp, extra)
        return {fold: replace(self, scale=scale, intercept=float(b[0]), coefficients=[float(v) for v in b[1:]], meta=meta) for (fold, scale), b in zip(models, done, strict=True)}

    def score(self) -> Column:
        """The probability of label 1, in Spark's own functions."""
        eta = F.lit(self.intercept)
        for f, c in zip(self.features, self.coefficients, strict=True):
            eta = eta + F.lit(c) * ((F.col(f) - F.lit(self.scale[f"mean_{f}"])) / F.lit(self.scale[f"sd_{f}"]))
        return 1.0 / (1.0 + F.exp(-eta))

    def predict_proba(self, df: DataFrame, out: str = "proba") -> DataFrame:
        extra = [c for c in df.columns if c not in self.features]
        return df.select(*extra, self.score().alias(out))

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return with_prediction(self.predict_proba(df), threshold)

    def save(self, path: str) -> None:
        facts = {"scale": self.scale, "features": self.features, "intercept": self.intercept, "coefficients": self.coefficients, "meta": asdict(self.meta)}
        _active().createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, path: str) -> "ScaledLogistic":
        facts = json.loads(_active().read.text(f"{path}/facts").first()["value"])
        meta = ModelMeta(**facts.pop("meta"))
        return cls(meta=meta, **facts)


def fold_scores(table: DataFrame, folds: DataFrame, models: dict[int, ScaledLogistic], date: str = "date") -> DataFrame:
    """(fold, symbol, date, y, proba) of every fold's test span; the coefficients are a table of one row per fold."""
    features = next(iter(models.values())).features
    rows = [(k, m.intercept, m.coefficients, [m.scale[f"mean_{f}"] for f in features], [m.scale[f"sd_{f}"] for f in features]) for k, m in models.items()]
    facts = table.sparkSession.createDataFrame(rows, "fold long, _b double, _c array<double>, _m array<double>, _s array<double>")
    tests = fold_roles(folds, table, date).filter(F.col("role") == "test").join(facts, "fold")
    eta = F.col("_b")
    for i, f in enumerate(features):
        eta = eta + F.col("_c")[i] * ((F.col(f) - F.col("_m")[i]) / F.col("_s")[i])
    return table.join(tests, date).select("fold", "symbol", date, "y", (1.0 / (1.0 + F.exp(-eta))).alias("proba"))


def _active() -> SparkSession:
    return SparkSession.getActiveSession()


def with_prediction(df: DataFrame, threshold: float = 0.5, proba: str = "proba") -> DataFrame:
    return df.withColumn("pred", (F.col(proba) >= threshold).cast("int"))


def classification_metrics(scored: DataFrame, by: str = "fold", threshold: float = 0.5, proba: str = "proba") -> DataFrame:
    """Rows, accuracy, exact AUC and log loss per ``by``.

    AUC comes from average-tie ranks (no binning) and is NULL when only one class is present. The rank step
    does not sort a whole fold in one task unless it is measured to be small.
    """
    d = with_prediction(with_rank_counts(scored, proba, by), threshold, proba)
    y = F.col("y").cast("double")
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1.0 - CLIP), F.col(proba)))
    rank = F.col("_below") + (F.col("_ties") + 1) / 2.0
    pos, neg = F.sum(y), F.sum(1.0 - y)
    area = (F.sum(rank * y) - pos * (pos + 1) / 2.0) / (pos * neg)
    return d.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"),
        F.when((pos > 0) & (neg > 0), area).alias("auc"),
        (-F.avg(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))).alias("logloss"),
    )


def train_walk_forward(
    table: DataFrame,
    folds: DataFrame,
    make_model: Callable[[], ScaledLogistic],
    threshold: float = 0.5,
    max_folds: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fit on each fold's train span, score its test span; (metrics per fold, scored rows).

    A model with ``fit_folds`` is fitted on all folds together and scored by one join. Of any other model (``fit``, ``predict_proba``) one is
    made per fold; threads then run over fold bounds, a handful of dates, and the rows stay in Spark.
    """
    data = settle(table, "training")
    if max_folds:
        folds = folds.orderBy("fold").limit(max_folds)
    folds = settle(folds, "folds")
    model = make_model()
    if hasattr(model, "fit_folds"):
        scored = settle(fold_scores(data, folds, model.fit_folds(data, folds)), "scored")
    else:
        scored = _one_by_one(data, folds, make_model)
    counts = data.groupBy("date").agg(F.count(F.lit(1)).alias("_rows"))
    in_train = fold_roles(folds, data).filter(F.col("role") == "train").join(counts, "date")
    sizes = in_train.groupBy("fold").agg(F.sum("_rows").alias("n_train"))
    metrics = classification_metrics(scored, "fold", threshold).join(sizes, "fold")
    return metrics.select("fold", "n_train", "n_test", "accuracy", "auc", "logloss"), scored


def _one_by_one(data: DataFrame, folds: DataFrame, make_model: Callable) -> DataFrame:
    path = new_path(data.sparkSession, "scored")

    def one(s) -> None:
        train = data.filter(F.col("date").between(F.lit(s["train_start"]), F.lit(s["train_end"])))
        test = data.filter(F.col("date").between(F.lit(s["test_start"]), F.lit(s["test_end"])))
        part = make_model().fit(train).predict_proba(test).select("symbol", "date", "y", "proba")
        part.write.parquet(f"{path}/fold={s['fold']}")

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        list(pool.map(one, folds.collect()))
    kinds = {f.name: f.dataType.simpleString() for f in [*data.schema.fields, *folds.schema.fields]}
    schema = f"fold {kinds['fold']}, symbol {kinds['symbol']}, date {kinds['date']}, y {kinds['y']}, proba double"
    return data.sparkSession.read.schema(schema).parquet(path)
